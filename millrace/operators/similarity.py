"""Jaccard similarity of entities by the keys they have, exact and by MinHash bands."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import linear_hash, primes
from millrace.operators.numbers import dense_index
from millrace.operators.pairs import shared_keys
from millrace.sources.scratch import written

def family(hashes: int, seed: int | None = None) -> list[int]:
    """The first primes, shuffled if there is a seed."""
    out = primes(hashes)
    if seed is not None:
        random.Random(seed).shuffle(out)
    return out


def signatures(rows: DataFrame, entity: str, index: str, universe: int, hashes: int, seed: int | None = None) -> DataFrame:
    """(entity, signature): the least of (p * x + i) mod universe over an entity's numbers x, for the i-th of the first primes (shuffled by a seed).

    Rows are dealt by entity first: minima of the few rows that a scan has of an entity would be `hashes` numbers for each row.
    """
    least = [F.min(linear_hash(F.col(index), p, i, universe)) for i, p in enumerate(family(hashes, seed))]
    return rows.select(entity, index).repartition(entity).groupBy(entity).agg(F.array(*least).alias("signature"))


def bands(signed: DataFrame, entity: str, n_bands: int, n_rows: int) -> DataFrame:
    """(entity, band, part): the sorted values of each band of a signature. Unlike a key of the values alone, bands of different places never meet."""
    parts = F.array(*[F.array_sort(F.slice("signature", b * n_rows + 1, n_rows)) for b in range(n_bands)])
    return signed.select(entity, F.posexplode(parts).alias("band", "part"))


def bucket_pairs(banded: DataFrame, entity: str) -> DataFrame:
    """(a, b) that share a band. banded: one row for each entity and band."""
    keyed = banded.select(F.col(entity).alias("entity"), F.xxhash64("band", "part").alias("bucket"))
    return shared_keys(written(keyed), "entity", "bucket").select("a", "b")


def set_sizes(rows: DataFrame, entity: str) -> DataFrame:
    return rows.groupBy(F.col(entity).alias("e")).agg(F.count("*").alias("size"))


def _jaccard(shared: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    out = shared.join(sizes.select(F.col("e").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("e").alias("b"), F.col("size").alias("nb")), "b")
    return out.withColumn("sim", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("sim") >= least).select("a", "b", "sim")


def jaccard_pairs(rows: DataFrame, entity: str, key: str, least: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b whose key sets have a Jaccard similarity of `least` or more. Exact; rows: distinct (entity, key)."""
    shared = shared_keys(rows, entity, key, lambda size: F.greatest(F.lit(1), F.ceil(F.lit(least - 1e-9) * size)))
    return _jaccard(shared, set_sizes(rows, entity), least)


def overlap_pairs(rows: DataFrame, entity: str, key: str, least: float) -> DataFrame:
    """(a, b, sim): shared keys as a share of the larger set, so each of a pair has `least` of its own keys in common with the other."""
    sizes = set_sizes(rows, entity)
    out = shared_keys(rows, entity, key, lambda size: F.greatest(F.lit(1), F.ceil(F.lit(least - 1e-9) * size))).join(sizes.select(F.col("e").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("e").alias("b"), F.col("size").alias("nb")), "b")
    return out.withColumn("sim", F.col("n") / F.greatest("na", "nb")).where(F.col("sim") >= least).select("a", "b", "sim")


def verified(pairs: DataFrame, rows: DataFrame, entity: str, key: str, least: float) -> DataFrame:
    """(a, b, sim) of the given pairs, counted on whole sets: each pair meets both sets as arrays, so it stays one row. Small for keys that are numbers."""
    sets = written(rows.groupBy(F.col(entity).alias("e")).agg(F.collect_list(key).alias("keys")))
    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("keys").alias("ka")), "a").join(sets.select(F.col("e").alias("b"), F.col("keys").alias("kb")), "b")
    counted = both.select("a", "b", F.size("ka").alias("na"), F.size("kb").alias("nb"), F.size(F.array_intersect("ka", "kb")).alias("n"))
    return counted.withColumn("sim", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where((F.col("n") > 0) & (F.col("sim") >= least)).select("a", "b", "sim")


def lsh_jaccard_pairs(rows: DataFrame, entity: str, key: str, least: float, n_bands: int = 50, n_rows: int = 4, seed: int | None = None) -> DataFrame:
    """As jaccard_pairs(), for the pairs that share a MinHash band: a subset of the exact result."""
    numbered = written(dense_index(rows, key))
    universe = numbered.count()
    if not universe:
        return rows.sparkSession.createDataFrame([], f"a {dict(rows.dtypes)[entity]}, b {dict(rows.dtypes)[entity]}, sim double")
    flat = written(rows.join(numbered, key).select(entity, F.col("idx").cast("int" if universe < 1 << 31 else "bigint").alias("idx")))
    signed = signatures(flat.withColumn("idx", F.col("idx").cast("bigint")), entity, "idx", universe, n_bands * n_rows, seed)
    return verified(bucket_pairs(bands(signed, entity, n_bands, n_rows), entity), flat, entity, "idx", least)
