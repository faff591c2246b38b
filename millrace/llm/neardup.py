"""Near-duplicate detection: fast similarity sketching, banding, and exact verification on full shingle sets.

The sketch has t coordinates. In rounds 0 to t - 1 every shingle is hashed to one coordinate and a value; in rounds t to 2t - 1 every shingle
goes to the coordinate of the round. A coordinate keeps the least value of the first round that reaches it, so each one of a non-empty set fills,
and the number of equal coordinates is as concentrated as for t independent MinHashes (Dahlgaard, Knudsen and Thorup, 2017).

A link of similarity s is missed only if all bands differ: (1 - s**rows)**bands, kept below `miss` at the threshold.
Equal sets are joined first by a 128-bit fingerprint. In each bucket all members are compared with the least one; members that are then still in
different components are compared through an exact join of their rarest shingles. So copies never become all pairs, and no bucket loses a link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, arrow_map, blob, chunks, dropped, excluded, mix64, named, restricted, swept, word_hashes, written

ROWS = 6


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the `width`-word shingles of each text (one for a shorter text with words), sorted within it, and offsets."""
    words, at = word_hashes([t.translate(LOWER) for t in texts])
    n = np.diff(at)
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), full)
    first = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(at[:-1], full)
    value = np.zeros(len(first), np.uint64)
    for k in range(width):
        value += words[first + k] * odd[k]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        some = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            some[has] += words[at[short[has]] + k] * odd[k]
        value, doc = np.concatenate([value, some + n[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)]), np.concatenate([doc, short])
    value = mix64(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
        value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def sketches(values: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of each non-empty set, as round << 32 | value; rows of empty sets stay at the maximum."""
    docs, empty = len(at) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * t, empty)
    owner = np.repeat(np.arange(docs), np.diff(at))
    left = owner
    for i in range(2 * t):
        if not len(values):
            break
        h = mix64(values ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, left * t + place, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        if i < 3 or i % 4 == 0:
            open_ = (out.reshape(docs, t) == empty).any(1)
            stay = open_[left]
            values, left = values[stay], left[stay]
    return out.reshape(docs, t)


def bands_needed(percent: int, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def band_hashes(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    out = np.arange(t // rows, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((n, 1), np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def sketched(documents: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, print, bands): set size, fingerprint of the set and its band hashes; the last two are null for an empty set."""
    t = ROWS * bands_needed(percent)

    def run(batch: dict[str, list]) -> dict[str, list]:
        n, prints, bands, texts = [], [], [], [x or b"" for x in batch["text"]]
        for low, high in chunks(texts):
            values, at = shingle_hashes(texts[low:high], width)
            sizes = np.diff(at)
            hashed = band_hashes(sketches(values, at, t)).view(np.int64)
            n += sizes.tolist()
            prints += [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(at, at[1:], strict=False)]
            bands += [x if k else None for k, x in zip(sizes, hashed, strict=True)]
        return {"id": batch["id"], "n": n, "print": prints, "bands": bands}

    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), f"id {dict(documents.dtypes)[id_col]}, n bigint, print binary, bands array<bigint>", run)


def with_sets(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set): the shingle hashes of each document."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts, sets = [x or b"" for x in batch["text"]], []
        for low, high in chunks(texts):
            values, at = shingle_hashes(texts[low:high], width)
            sets.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64))))
        return {"id": batch["id"], "set": pa.concat_arrays(sets) if sets else []}

    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), f"id {dict(documents.dtypes)[id_col]}, set array<bigint>", run)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges (a, b): the least id that it reaches. Min-label rounds with pointer jumping, each a written table."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        following = written(lower.join(jump, "component").select("id", F.least("component", "root").alias("component"), (F.least("component", "root") < F.col("was")).alias("moved")))
        dropped(labels)
        labels = following
    dropped(both)
    return labels.select("id", "component")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    size_a, size_b, both = F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .where(100 * both >= percent * (size_a + size_b - both))
        .select("a", "b")
    )


def sharing_rare(docs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of documents (id, component, set) of different components that can have percent similarity: no such pair is left out.

    Elements are ordered by rising frequency. A pair that is similar enough shares one of the first n - ceil(percent n) + 1 of each set of n, and its
    first shared one leaves both enough elements behind it. Elements whose documents cannot meet this, even with the shortest of them, or that lie in
    one component only, are dropped before they are joined, so a large group of near copies that differ a little too much makes no pairs.
    """
    rows = docs.select("id", "component", F.size("set").alias("n"), F.explode("set").alias("s"))
    common = written(rows.groupBy("s").agg(F.count("*").alias("f"), (F.min("component") < F.max("component")).alias("across")).where("f > 1"))
    each = rows.join(common, "s").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s", "across"))).alias("order"))
    place = F.col("n") - F.size("order") + F.col("i")
    first = each.select("id", "component", "n", "order", F.posexplode("order").alias("i", "e")).where(place <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).where("e.across")
    first = written(first.select("id", "component", "n", F.col("e.s").alias("s"), (F.col("n") - place).alias("rest")))
    least = written(first.groupBy("s").agg(F.min("n").alias("least")))
    able = written(first.join(least, "s").where((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least"))).select("id", "component", "n", "s", "rest"))
    across = written(able.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("s"))
    able = written(restricted(able, across, "s"))
    x, y = able.alias("x"), able.alias("y")
    near = (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & ((100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n")))
    return x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of documents; other columns are ignored.

    Null, empty and blank texts have the empty set and are linked with nothing: component_id is their own id. A null id is never linked and has a
    null component_id and kept = true. Equal texts always share a component; repeated rows of one id get the same component and are all kept or not.
    An empty table gives an empty result.
    """
    base = written(sketched(documents, width, percent, id_col, text_col))
    told = base.where(F.col("id").isNotNull() & F.col("print").isNotNull())
    first = written(told.groupBy("print").agg(F.min("id").alias("rep")))
    # Each distinct set once; an id that has several texts may stand for several sets.
    heads = told.join(first, "print").where("id = rep").dropDuplicates(["print"]).select(F.col("id").alias("rep"), "n", "bands")
    banded = heads.select("rep", F.explode("bands").alias("band"))
    # Each side of the joins below is a written table, so that Spark can split the partitions of frequent keys.
    banded = written(banded)
    shared = written(banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("band", "pivot"))
    members = written(banded.join(shared, "band"))
    dropped(banded)
    swept(documents.sparkSession)
    stars = written(members.where("pivot < rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    ids = written(members.select(F.col("rep").alias(id_col)).distinct())
    sets = written(with_sets(restricted(documents, ids, id_col), width, id_col, text_col).dropDuplicates())
    links = written(verified(stars, sets, percent))
    once = written(components(links))
    # Members of a bucket that are still apart: an exact join of their rarest shingles finds all links between them.
    placed = written(members.join(once.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component")))
    apart = written(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"))
    mixed = written(restricted(placed, apart, "band").select(F.col("rep").alias("id"), "component").distinct())
    more = sharing_rare(mixed.join(sets, "id"), percent).join(stars, ["a", "b"], "left_anti")
    more = written(verified(written(more), sets, percent))
    if more.limit(1).count():
        at = once.select(F.col("id").alias("k"), "component")
        ends = more.join(at.withColumnRenamed("k", "a").withColumnRenamed("component", "ca"), "a", "left").join(at.withColumnRenamed("k", "b").withColumnRenamed("component", "cb"), "b", "left")
        bridges = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        joined = components(bridges).select(F.col("id").alias("component"), F.col("component").alias("root"))
        every = once.unionByName(bridges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))).distinct()
        once = written(every.join(joined, "component", "left").groupBy("id").agg(F.min(F.coalesce("root", "component")).alias("component")))
    dropped(members, shared, stars, ids, sets, links, placed, apart, mixed)
    swept(documents.sparkSession)
    # The representative's component, by set; then rows with one id take the least of theirs.
    roots = first.join(once.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("root"))
    out = base.select("id", "n", "print").join(roots, "print", "left").select("id", "n", F.coalesce("root", "id").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN near ON a = other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """documents without those that near_duplicates() does not keep.

    Rows without words, and rows of a null id, all stay. Of a kept id that has several rows, each text that is no near copy of another of its texts
    stays once: of near copies the one of the smallest hash, of rows of one text the first by the JSON of all its columns.
    """
    found = written(near_duplicates(documents, id_col, text_col, width, percent).where(F.col(named(id_col)).isNotNull() & (F.col("n_shingles") > 0)).select(id_col, "kept"))
    gone = written(found.where("NOT kept").select(id_col).distinct())
    repeated = written(found.where("kept").groupBy(id_col).count().where("count > 1").select(id_col))
    dropped(found)
    out, columns = excluded(documents, gone, id_col), [F.col(named(c)) for c in documents.columns]
    if repeated.limit(1).count():
        wordy = F.regexp_replace(F.coalesce(F.col(named(text_col)), F.lit("")), r"[\x20\x09-\x0D]", "") != ""
        row = F.struct(*columns)
        again = restricted(out.where(wordy), repeated, id_col).select(F.struct(F.col(named(id_col)).alias("id"), F.xxhash64(F.col(named(text_col))).alias("h")).alias("key"), F.col(named(text_col)).alias("text"), row.alias("row"))
        again = written(again.groupBy("key").agg(F.min_by("text", F.to_json("row")).alias("text"), F.min_by("row", F.to_json("row")).alias("row")))
        kept = near_duplicates(again.select("key", "text"), "key", "text", width, percent).where("kept").select("key")
        chosen = again.join(kept, "key", "left_semi").select("row.*")
        out = excluded(out, repeated, id_col).select(*columns).unionByName(restricted(out.where(~wordy), repeated, id_col).select(*columns)).unionByName(chosen)
    return out.select(*columns)
