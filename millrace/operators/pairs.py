"""Pairs of entities that share keys: the kernel of co-occurrence graphs, Jaccard pairs and co-rated pairs.

A key of f entities makes f * (f - 1) / 2 pairs. They are not shuffled one by one: entities get numbers, each key becomes the sorted list of its numbers,
and each entity of the list is sent with the part of the list after it, so a pair takes some four bytes. Pairs are formed where all lists of their
first entity have come together, and only those that are kept go further. Tasks are so many that each forms some PAIRS_A_TASK pairs.

Keys of more than HEAVY entities make no lists: a pair with `least` shared keys shares a light one, or at least `least` heavy ones, so candidates come
from light keys and from each entity's rarest heavy keys (all but its least - 1 most frequent), and are counted exactly afterwards by joins on (entity, key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.numbers import dense_index
from millrace.sources.scratch import fits, written

HEAVY = 1_000
#: Pairs that a task forms, rows of (entity, key) of which it makes lists, and pairs that it sends in lists: about so many, however large the input.
PAIRS_A_TASK, ROWS_A_TASK, SENT_A_TASK = 2_000_000, 1_000_000, 4_000_000


def _spread(total: int, each: int) -> int:
    return max(1, -(-total // each))


def _listed(flat: DataFrame, sums: list[Column], valued: bool, rows: int, pairs: int) -> DataFrame:
    """(a, b, *sums) of numbers a < b with n >= a's `few`, of rows (e, few, k) or (e, few, k, v)."""
    each = F.struct("e", "few", *(["v"] if valued else []))
    lists = flat.repartition(max(_spread(rows, ROWS_A_TASK), _spread(pairs, SENT_A_TASK)), "k").groupBy("k").agg(F.sort_array(F.collect_list(each)).alias("l")).where(F.size("l") > 1)
    whole = lists.select(F.col("l.few").alias("few"), F.col("l.e").alias("es"), *([F.col("l.v").alias("vs")] if valued else []))
    at = whole.select("*", F.posexplode("es").alias("i", "a")).where(F.col("i") < F.size("es") - 1)
    rest = [F.slice(c, F.col("i") + 2, F.size("es")).alias(c) for c in (["es", "vs"] if valued else ["es"])]
    sent = at.select("a", F.col("few")[F.col("i")].alias("few"), *([F.col("vs")[F.col("i")].alias("x")] if valued else []), *rest).repartition(_spread(pairs, PAIRS_A_TASK), "a")
    formed = sent.select("a", "few", "x", F.inline(F.arrays_zip("es", "vs")).alias("b", "y")) if valued else sent.select("a", "few", F.explode("es").alias("b"))
    return formed.where("a < b").groupBy("a", "few", "b").agg(*sums).where("n >= few").drop("few")


def shared_keys(rows: DataFrame, entity: str, key: str, least: int | Callable[[Column], Column] = 1, value: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """(a, b, n): entities a < b with n >= `least` keys in common; with `value`, also sx, sy, sxx, syy, sxy of a's and b's values over those keys.

    least: a number, or a function from an entity's number of keys to the fewest that it must share with any partner. rows must be distinct in
    (entity, key); they are read twice. Null entities and keys are left out.
    """
    named = rows.where(F.col(entity).isNotNull() & F.col(key).isNotNull()).select(F.col(entity).alias("name"), F.col(key).alias("k"), *([F.col(value).cast("double").alias("v")] if value else []))
    columns = ["v"] if value else []
    sums = [F.count("*").alias("n")]
    if value:
        sums += [F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy")]
    sizes = written(named.groupBy("name").agg(F.count("*").alias("size")))
    kind = "int" if fits(sizes, (1 << 31) - 1) else "bigint"
    need = F.lit(least) if isinstance(least, int) else least(F.col("size"))
    ids = written(dense_index(sizes, "name", "e").join(sizes, "name").select(F.col("e").cast(kind).alias("e"), "name", need.cast("int").alias("need")))
    flat = written(named.join(ids, "name").select("e", "need", "k", *columns))
    per_key = flat.groupBy("k").agg(F.count("*").alias("f"))
    light, most, pairs = per_key.agg(F.sum(F.when(F.col("f") <= heavy, F.col("f"))), F.max("f"), F.sum(F.when(F.col("f") <= heavy, F.col("f") * (F.col("f") - 1) / 2))).first()
    if not most or most <= heavy:
        found = _listed(flat.withColumnRenamed("need", "few"), sums, bool(value), light or 0, int(pairs or 0))
    else:
        found = _with_heavy(flat, per_key, heavy, ids, columns, sums, light or 0, int(pairs or 0))
    a, b = ids.select(F.col("e").alias("a"), F.col("name").alias("first"), F.col("need").alias("na")), ids.select(F.col("e").alias("b"), F.col("name").alias("second"), F.col("need").alias("nb"))
    kept = found.join(a, "a").join(b, "b").where(F.col("n") >= F.greatest("na", "nb"))
    turned = F.col("first") > F.col("second")
    swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
    names = [c for c in found.columns if c not in ("a", "b")]
    return kept.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), *[F.when(turned, F.col(swapped[c])).otherwise(F.col(c)).alias(c) if c in swapped else F.col(c) for c in names])


def _with_heavy(flat: DataFrame, per_key: DataFrame, heavy: int, ids: DataFrame, columns: list[str], sums: list[Column], light_rows: int, light_pairs: int) -> DataFrame:
    """(a, b, *sums) where some keys are heavy."""
    big = written(per_key.where(F.col("f") > heavy))
    big = F.broadcast(big) if fits(big) else big
    light = flat.join(big.select("k"), "k", "left_anti")
    hot = flat.join(big, "k")
    each = written(hot.groupBy("e").agg(F.count("*").alias("h")).join(ids, "e", "right").select("e", F.coalesce("h", F.lit(0)).alias("h"), "need"))
    few = light.join(each.select("e", "h"), "e").select("e", F.greatest(F.col("need") - F.col("h"), F.lit(1)).cast("int").alias("few"), "k")
    seen = _listed(few, [F.count("*").alias("n")], False, light_rows, light_pairs)
    a, b = each.select(F.col("e").alias("a"), F.col("h").alias("ha"), F.col("need").alias("na")), each.select(F.col("e").alias("b"), F.col("h").alias("hb"), F.col("need").alias("nb"))
    seen = seen.join(a, "a").join(b, "b").where(F.col("n") + F.least("ha", "hb") >= F.greatest("na", "nb")).select("a", "b")
    rank = F.row_number().over(W.partitionBy("e").orderBy("f", "k"))
    rare = written(hot.withColumn("rank", rank).join(each.select("e", "h"), "e").where(F.col("rank") <= F.col("h") - F.col("need") + 1).select("e", F.lit(1).alias("few"), "k"))
    n, pairs = rare.groupBy("k").agg(F.count("*").alias("f")).agg(F.sum("f"), F.sum(F.col("f") * (F.col("f") - 1) / 2)).first()
    pairs = written(seen.unionByName(_listed(rare, [F.count("*").alias("n")], False, n or 0, int(pairs or 0)).select("a", "b")).distinct())
    left = pairs.join(flat.select(F.col("e").alias("a"), "k", *[F.col(c).alias("x") for c in columns]), "a")
    both = left.join(flat.select(F.col("e").alias("b"), "k", *[F.col(c).alias("y") for c in columns]), ["b", "k"])
    return both.groupBy("a", "b").agg(*sums)
