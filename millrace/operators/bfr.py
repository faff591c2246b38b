"""Clustering of points that come in chunks, by summaries: discard sets (DS), compression sets (CS) and retained points (RS).

A summary is (label, n, sums, squares). Points stay distributed; what the driver holds are summaries, some 5k a round and d numbers each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import deviation, mahalanobis
from millrace.operators.similarity import dense_index
from millrace.operators.stats import hash_sample
from millrace.sources.scratch import written

SUMMARY = "label bigint, n bigint, sums array<double>, squares array<double>"
MOST_MERGES = 500
#: Softening of the deviations, as in mahalanobis().
SOFT = 0.001


def limit_of(dims: int, factor: float = 2.0) -> float:
    """The distance at which a point is taken in: factor times the root of the dimensions."""
    return factor * math.sqrt(dims)


def summary(points: DataFrame, dims: int) -> DataFrame:
    """(label, n, sums, squares) of labelled points (label, x). One aggregation with map-side sums."""
    x = [F.col("x")[i] for i in range(dims)]
    return points.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*[F.sum(v * v) for v in x]).alias("squares"))


def united(first: DataFrame, second: DataFrame, dims: int) -> DataFrame:
    """Summaries added up by label."""
    both = first.unionByName(second)
    return both.groupBy("label").agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(dims)]).alias(c) for c in ("sums", "squares")])


def nearest(points: DataFrame, clusters: DataFrame, limit: float, softening: float = SOFT) -> DataFrame:
    """points with (near, distance): the cluster of the least Mahalanobis distance (of ties, the smallest label), null where that is above the limit.

    The clusters go to each row as one array, so rows are neither multiplied nor shuffled.
    """
    each = F.struct("label", F.transform("sums", lambda s: s / F.col("n")).alias("mean"), deviation("n", "sums", "squares").alias("sd"))
    row = clusters.agg(F.array_sort(F.collect_list(each)).alias("clusters"))
    at = F.array_min(F.transform("clusters", lambda c: F.struct(mahalanobis(F.col("x"), c["mean"], c["sd"], softening).alias("distance"), c["label"].alias("label"))))
    found = points.crossJoin(F.broadcast(row)).withColumn("at", at)
    return found.select(*points.columns, F.when(F.col("at.distance") <= limit, F.col("at.label")).alias("near"), F.col("at.distance").alias("distance"))


def kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """points with the label of their cluster, 0 to k - 1; of fewer than two points, all 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 2 or points.limit(2).count() < 2:
        return points.withColumn("label", F.lit(0).cast("bigint"))
    vectors = points.withColumn("features", array_to_vector("x"))
    fitted = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(vectors)
    return fitted.transform(vectors).withColumn("label", F.col("label").cast("bigint")).select(*points.columns, "label")


def merge_summaries(rows: list[tuple], limit: float, most: int = MOST_MERGES, softening: float = SOFT) -> tuple[list[tuple], dict[int, int]]:
    """Clusters (label, n, sums, squares) joined pair by pair, the closest first, while centroids are within the limit by the deviations of the earlier one; and the new label of each old one."""
    held = {r[0]: (r[1], np.array(r[2], float), np.array(r[3], float)) for r in sorted(rows, key=lambda r: r[0])}
    renamed = {k: k for k in held}
    for _ in range(most):
        names = list(held)
        if len(names) < 2:
            break
        n = np.array([held[k][0] for k in names], float)[:, None]
        mean = np.stack([held[k][1] for k in names]) / n
        sd = np.sqrt(np.maximum(np.stack([held[k][2] for k in names]) / n - mean**2, 0)) + softening
        best = None
        for i in range(len(names) - 1):
            gaps = np.sqrt((((mean[i + 1 :] - mean[i]) / sd[i]) ** 2).sum(1))
            j = int(gaps.argmin())
            if best is None or gaps[j] < best[0]:
                best = (float(gaps[j]), names[i], names[i + 1 + j])
        if best[0] > limit:
            break
        _, a, b = best
        held[a] = tuple(x + y for x, y in zip(held[a], held.pop(b), strict=True))
        renamed = {k: a if v == b else v for k, v in renamed.items()}
    return [(k, int(n), s.tolist(), q.tolist()) for k, (n, s, q) in held.items()], renamed


def hierarchical(points: DataFrame, cutoff: float, rows: int = 1000, most: int = MOST_MERGES) -> DataFrame:
    """(id, label): in slices of so many points, the two closest groups by Euclidean distance of centroids join until none is within the cutoff. Labels are slice * rows + place."""
    kind = dict(points.dtypes)["id"]
    sliced = points.select("id", "x").join(dense_index(points, "id"), "id").withColumn("slice", F.floor(F.col("idx") / rows).cast("bigint"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        mean, size = np.stack(pdf["x"].tolist()).astype(float), np.ones(len(pdf))
        label = np.arange(len(pdf))
        gaps = np.sqrt(np.maximum((mean**2).sum(1)[:, None] + (mean**2).sum(1)[None] - 2 * mean @ mean.T, 0))
        np.fill_diagonal(gaps, np.inf)
        for _ in range(most):
            i, j = divmod(int(gaps.argmin()), len(pdf))
            if gaps[i, j] > cutoff or not np.isfinite(gaps[i, j]):
                break
            mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            label[label == j] = i
            gaps[j], gaps[:, j] = np.inf, np.inf
            alive = np.isfinite(gaps[i])
            gaps[i, alive] = gaps[alive, i] = np.sqrt(((mean[alive] - mean[i]) ** 2).sum(1))
        return pd.DataFrame({"id": pdf["id"], "label": pdf["slice"] * rows + label})

    return sliced.groupBy("slice").applyInPandas(join, f"id {kind}, label bigint")


def largest(labelled: DataFrame, k: int) -> DataFrame:
    """(label) of the k clusters of most points; of ties, the smaller label."""
    return labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k).select("label")


class Rounds:
    """The state between chunks. add() takes a chunk of (id, x); labels() and statistics() may be asked for at any time."""

    def __init__(self, spark: SparkSession, k: int, dims: int, seed: int = 1, factor: float = 2.0, fraction: float = 0.8):
        self.spark, self.k, self.dims, self.seed, self.fraction = spark, k, dims, seed, fraction
        self.limit = limit_of(dims, factor)
        self.ds: list[tuple] = []
        self.cs: list[tuple] = []
        self.rs: DataFrame | None = None
        self.ds_members: list[DataFrame] = []
        self.cs_members: list[DataFrame] = []
        self.stats: list[tuple] = []
        self.next = 0

    def _table(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SUMMARY)

    def _rows(self, df: DataFrame) -> list[tuple]:
        return sorted((r.label, r.n, r.sums, r.squares) for r in df.collect())

    def _split(self, points: DataFrame) -> None:
        """Clusters points finely: clusters of several points become compression sets, single ones are retained."""
        n = points.count()
        if n < 2:
            self.rs = points
            return
        labelled = written(kmeans(points, min(5 * self.k, n), self.seed))
        single = labelled.groupBy("label").agg(F.count("*").alias("size")).where("size = 1").select("label")
        self.rs = written(labelled.join(F.broadcast(single), "label", "left_semi").select("id", "x"))
        new = written(labelled.join(F.broadcast(single), "label", "left_anti").withColumn("label", F.col("label") + self.next))
        self.next += 5 * self.k
        self.cs += self._rows(summary(new, self.dims))
        self.cs_members.append(new.select("id", "label"))

    def add(self, chunk: DataFrame) -> None:
        """Takes in a chunk. Null points are left out; an empty chunk only adds its statistics."""
        points = written(chunk.where("id IS NOT NULL AND x IS NOT NULL").select("id", "x"))
        if not self.ds:
            some = written(kmeans(hash_sample(points, "id", self.fraction, self.seed), int(2.5 * self.k), self.seed))
            top = {r.label: i for i, r in enumerate(largest(some, self.k).collect())}
            if top:
                names = F.create_map(*[F.lit(v) for kv in top.items() for v in kv])
                held = written(some.where(F.col("label").isin(*top)).withColumn("label", names[F.col("label")].cast("bigint")))
                self.ds = self._rows(summary(held, self.dims))
                self.ds_members.append(held.select("id", "label"))
                self.next = self.k
                self._split(written(points.join(held.select("id"), "id", "left_anti")))
        else:
            at = written(nearest(points, self._table(self.ds), self.limit))
            mine, rest = at.where("near IS NOT NULL").select("id", "x", F.col("near").alias("label")), at.where("near IS NULL").select("id", "x")
            self.ds = self._rows(united(self._table(self.ds), summary(mine, self.dims), self.dims))
            self.ds_members.append(mine.select("id", "label"))
            if self.cs:
                at = written(nearest(rest, self._table(self.cs), self.limit))
                mine, rest = at.where("near IS NOT NULL").select("id", "x", F.col("near").alias("label")), at.where("near IS NULL").select("id", "x")
                self.cs = self._rows(united(self._table(self.cs), summary(mine, self.dims), self.dims))
                self.cs_members.append(mine.select("id", "label"))
            self._split(written(rest if self.rs is None else rest.unionByName(self.rs)))
            self._merge()
        self.stats.append((len(self.stats) + 1, len(self.ds), sum(r[1] for r in self.ds), len(self.cs), sum(r[1] for r in self.cs), self.rs.count() if self.rs is not None else 0))

    def _merge(self) -> None:
        self.cs, renamed = merge_summaries(self.cs, self.limit)
        if any(a != b for a, b in renamed.items()):
            names = F.broadcast(self.spark.createDataFrame(list(renamed.items()), "label bigint, into bigint"))
            whole = self.cs_members[0]
            for m in self.cs_members[1:]:
                whole = whole.unionByName(m)
            self.cs_members = [written(whole.join(names, "label").select("id", F.col("into").alias("label")))]

    def outside(self, points: DataFrame) -> DataFrame:
        """(id, x) of the points that are in no discard set. Null points are left out."""
        out = points.where("id IS NOT NULL AND x IS NOT NULL").select("id", "x")
        for held in self.ds_members:
            out = out.join(held.select("id"), "id", "left_anti")
        return out

    def labels(self) -> DataFrame:
        """(id, label): of discard sets their cluster, of compression sets that of the nearest discard set within the limit, of all other points -1."""
        out = None
        parts = list(self.ds_members)
        if self.cs:
            centres = self._table(self.cs).select("label", F.transform("sums", lambda s: s / F.col("n")).alias("x"))
            into = nearest(centres, self._table(self.ds), self.limit).select("label", F.coalesce("near", F.lit(-1)).alias("into"))
            parts += [m.join(F.broadcast(into), "label").select("id", F.col("into").alias("label")) for m in self.cs_members]
        if self.rs is not None:
            parts.append(self.rs.select("id", F.lit(-1).cast("bigint").alias("label")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out if out is not None else self.spark.createDataFrame([], "id string, label bigint")

    def statistics(self) -> DataFrame:
        """A row for each round: clusters and points of the discard and compression sets, and retained points."""
        return self.spark.createDataFrame(self.stats, "round_id bigint, nof_cluster_discard bigint, nof_point_discard bigint, nof_cluster_compression bigint, nof_point_compression bigint, nof_point_retained bigint")


def clustered(spark: SparkSession, chunks: Iterator[DataFrame], k: int, dims: int, seed: int = 1) -> Rounds:
    """All chunks in their order."""
    out = Rounds(spark, k, dims, seed)
    for chunk in chunks:
        out.add(chunk)
    return out
