"""Queries over points: summaries, distances, chunked clustering, agreement with known labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import bfr, metrics
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources.scratch import written

DIMS, CHUNKS, K = V.DIMS, 5, 8
#: A limit that turns some points away.
LIMIT = 8.0
SUMMARY = "summary AS (SELECT label, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM points GROUP BY 1, 2)"
DISTANCES = """distances AS (
  SELECT p.id, s.label, sqrt(sum(power((p.v - s.s / s.n) / (sqrt(greatest(s.q / s.n - power(s.s / s.n, 2), 0)) + 0.001), 2))) AS distance FROM points p JOIN summary s USING (i) GROUP BY 1, 2),
nearest AS (SELECT id, label, distance FROM distances QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, label) = 1)"""


def _summary(spark, d):
    return bfr.summary(V.points(spark, d), DIMS)


@query(f"{V.with_(V.POINTS, SUMMARY)} SELECT label, i - 1 AS dim, n, round(s, 6) AS total, round(q, 6) AS squares FROM summary")
def op_cluster_summary(spark, d):
    each = _summary(spark, d).select("label", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "z"))
    return each.select("label", F.col("dim").cast("bigint").alias("dim"), "n", F.round("z.sums", 6).alias("total"), F.round("z.squares", 6).alias("squares"))


@query(f"{V.with_(V.POINTS, SUMMARY, DISTANCES)} SELECT id, CASE WHEN distance <= {LIMIT} THEN label ELSE -1 END AS near, round(distance, 6) AS distance FROM nearest")
def op_bfr_assign_ds(spark, d):
    return bfr.nearest(V.points(spark, d).select("id", "x"), _summary(spark, d), LIMIT).select("id", F.coalesce("near", F.lit(-1)).alias("near"), F.round("distance", 6).alias("distance"))


_STRICT = DISTANCES.replace(" + 0.001)", ")")


@query(f"{V.with_(V.POINTS, SUMMARY, _STRICT)} SELECT id, CASE WHEN distance <= 7.5 THEN label ELSE -1 END AS near FROM nearest")
def op_bfr_assign_fixed_limit(spark, d):
    """The older rule: a fixed limit and no softening."""
    return bfr.nearest(V.points(spark, d).select("id", "x"), _summary(spark, d), 7.5, softening=0.0).select("id", F.coalesce("near", F.lit(-1)).alias("near"))


@query(f"{V.with_(V.POINTS, SUMMARY, DISTANCES)} SELECT id, label AS near FROM nearest")
def op_cross_nearest(spark, d):
    return bfr.nearest(V.points(spark, d).select("id", "x"), _summary(spark, d), float("inf")).select("id", "near")


#: Compression sets: a part of each label's points; the discard sets are the other points.
_SPLIT = """ds AS (SELECT label, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM points WHERE id % 3 <> 0 GROUP BY 1, 2),
cs AS (SELECT label + 100 AS label, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM points WHERE id % 3 = 0 GROUP BY 1, 2)"""


def _sets(spark, d):
    points = V.points(spark, d)
    return bfr.summary(points.where("id % 3 <> 0"), DIMS), bfr.summary(points.where("id % 3 = 0").withColumn("label", F.col("label") + 100), DIMS)


_CS_DS = """gaps AS (
  SELECT c.label AS cs, s.label, sqrt(sum(power((c.s / c.n - s.s / s.n) / (sqrt(greatest(s.q / s.n - power(s.s / s.n, 2), 0)) + 0.001), 2))) AS distance FROM cs c JOIN ds s USING (i) GROUP BY 1, 2)"""


@query(f"{V.with_(V.POINTS, _SPLIT, _CS_DS)} SELECT cs AS label, CASE WHEN distance <= 16 THEN label ELSE -1 END AS into FROM gaps QUALIFY row_number() OVER (PARTITION BY cs ORDER BY distance, label) = 1")
def op_bfr_merge_cs_ds(spark, d):
    ds, cs = _sets(spark, d)
    centres = cs.select("label", F.transform("sums", lambda s: s / F.col("n")).alias("x"))
    return bfr.nearest(centres, ds, bfr.limit_of(DIMS)).select("label", F.coalesce("near", F.lit(-1)).alias("into"))


#: Labels whose points make discard sets; those of the others make compression sets.
HELD = 4


@query(
    f"""{V.with_(V.POINTS, SUMMARY, DISTANCES)},
taken AS (SELECT DISTINCT id FROM distances WHERE label < {HELD} AND distance <= {LIMIT})
SELECT id, CASE WHEN distance <= {LIMIT} THEN label ELSE -1 END AS near FROM distances WHERE label >= {HELD} AND id NOT IN (SELECT id FROM taken)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, label) = 1"""
)
def op_bfr_assign_cs(spark, d):
    """The points that no discard set takes, with the compression set that does."""
    sets = _summary(spark, d)
    rest = bfr.nearest(V.points(spark, d).select("id", "x"), sets.where(F.col("label") < HELD), LIMIT).where("near IS NULL").select("id", "x")
    return bfr.nearest(rest, sets.where(F.col("label") >= HELD), LIMIT).select("id", F.coalesce("near", F.lit(-1)).alias("near"))


@query(
    f"""{V.with_(V.POINTS, _SPLIT.replace('id % 3 = 0', 'id % 3 = 0 AND id % 7 <> 0'), _CS_DS)}, into_ds AS (
  SELECT cs, CASE WHEN distance <= 16 THEN label ELSE -1 END AS label FROM gaps QUALIFY row_number() OVER (PARTITION BY cs ORDER BY distance, label) = 1)
SELECT DISTINCT id, CAST(CASE WHEN id % 3 <> 0 THEN p.label WHEN id % 7 = 0 THEN -1 ELSE d.label END AS BIGINT) AS label FROM points p JOIN into_ds d ON d.cs = p.label + 100"""
)
def op_bfr_finalize(spark, d):
    """Labels of all points for known sets: two of three points in discard sets, of the others every seventh retained and the rest in compression sets."""
    points = V.points(spark, d)
    rest = points.where("id % 3 = 0 AND id % 7 <> 0").withColumn("label", (F.col("label") + 100).cast("bigint"))
    state = bfr.Rounds(spark, K, DIMS)
    for sets, members, some in ((state.ds, state.ds_members, points.where("id % 3 <> 0").withColumn("label", F.col("label").cast("bigint"))), (state.cs, state.cs_members, rest)):
        sets += state._rows(bfr.summary(some, DIMS))
        members.append(some.select("id", "label"))
    state.rs = points.where("id % 3 = 0 AND id % 7 = 0").select("id", "x")
    return state.labels()


@query(f"{V.with_(V.POINTS, SUMMARY, DISTANCES)} SELECT id, label AS near, round(distance, 6) AS distance FROM nearest")
def op_min_argmin(spark, d):
    """The least distance and the cluster that has it."""
    return bfr.nearest(V.points(spark, d).select("id", "x"), _summary(spark, d), float("inf")).select("id", "near", F.round("distance", 6).alias("distance"))


@query(f"{V.with_(V.POINTS, SUMMARY)} SELECT label, i - 1 AS dim, n, round(s, 6) AS total FROM summary")
def op_bfr_united(spark, d):
    ds, cs = _sets(spark, d)
    both = bfr.united(ds, cs.withColumn("label", F.col("label") - 100), DIMS)
    each = both.select("label", "n", F.posexplode("sums").alias("dim", "total"))
    return each.select("label", F.col("dim").cast("bigint").alias("dim"), "n", F.round("total", 6).alias("total"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3".replace("SELECT label", "SELECT CAST(label AS BIGINT) AS label"))
def op_topk_clusters(spark, d):
    points = V.points(spark, d)
    return points.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(bfr.largest(points, 3)), "label", "left_semi")


@query(f"{V.with_(V.POINTS, SUMMARY)} SELECT p.id, round(sqrt(sum(power(p.v - s.s / s.n, 2))), 6) AS distance FROM points p JOIN summary s USING (label, i) GROUP BY 1")
def op_euclidean(spark, d):
    centres = _summary(spark, d).select("label", F.transform("sums", lambda s: s / F.col("n")).alias("mean"))
    return V.points(spark, d).join(centres, "label").select("id", F.round(C.euclidean("x", "mean"), 6).alias("distance"))


@query(
    f"""{V.with_(V.POINTS, SUMMARY)} SELECT p.id, round(sqrt(sum(power((p.v - s.s / s.n) / (sqrt(greatest(s.q / s.n - power(s.s / s.n, 2), 0)) + 0.001), 2))), 6) AS distance
FROM points p JOIN summary s USING (label, i) GROUP BY 1"""
)
def op_mahalanobis(spark, d):
    own = _summary(spark, d).select("label", F.transform("sums", lambda s: s / F.col("n")).alias("mean"), C.deviation("n", "sums", "squares").alias("sd"))
    return V.points(spark, d).join(own, "label").select("id", F.round(C.mahalanobis("x", "mean", "sd"), 6).alias("distance"))


_NMI = """cells AS (SELECT label AS t, near AS p, count(*) AS n FROM pairs GROUP BY 1, 2), total AS (SELECT CAST(sum(n) AS DOUBLE) AS a FROM cells),
nt AS (SELECT t, sum(n) AS x FROM cells GROUP BY 1), np AS (SELECT p, sum(n) AS y FROM cells GROUP BY 1)
SELECT round(2 * (SELECT sum(n / a * ln(n * a / (x * y))) FROM cells JOIN nt USING (t) JOIN np USING (p), total)
  / ((SELECT sum(-x / a * ln(x / a)) FROM nt, total) + (SELECT sum(-y / a * ln(y / a)) FROM np, total)), 6) AS nmi"""


@query(f"{V.with_('pairs AS (SELECT label, vec_id % 4 + label // 2 AS near FROM embeddings)')}, {_NMI}")
def op_nmi(spark, d):
    return metrics.nmi(V.points(spark, d).withColumn("found", F.col("id") % 4 + F.floor(F.col("label") / 2)), "label", "found").select(F.round("nmi", 6).alias("nmi"))


def _rounds(spark, d):
    points = V.points(spark, d).select("id", "x")
    return bfr.clustered(spark, (points.where(F.col("id") % CHUNKS == i) for i in range(CHUNKS)), K, DIMS)


@query()
def op_bfr_seed(spark, d):
    some = bfr.kmeans(bfr.hash_sample(V.points(spark, d).select("id", "x"), "id", 0.8), int(2.5 * K), 1)
    return some.join(F.broadcast(bfr.largest(some, K)), "label", "left_semi").select("id", "label")


@query()
def op_bfr_residual(spark, d):
    """All points that are in no discard set after the first round, here of all points, whether left out of its sample or of the largest clusters."""
    points = V.points(spark, d).select("id", "x")
    state = bfr.Rounds(spark, K, DIMS)
    state.add(points)
    rest = written(state.outside(points))
    labelled = written(bfr.kmeans(rest, min(5 * K, max(1, rest.count())), 1))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return labelled.join(F.broadcast(sizes), "label").select("id", "label", F.when(F.col("n") == 1, "RS").otherwise("CS").alias("kind"))


@query()
def op_bfr_merge_cs(spark, d):
    summary = bfr.summary(bfr.kmeans(V.points(spark, d).select("id", "x"), 3 * K, 1), DIMS)
    _, renamed = bfr.merge_summaries([(r.label, r.n, r.sums, r.squares) for r in summary.collect()], bfr.limit_of(DIMS))
    return spark.createDataFrame(sorted(renamed.items()), "label bigint, into bigint")


@query()
def op_bfr_recluster_rs(spark, d):
    """The points that the rounds retain, clustered once more."""
    state = _rounds(spark, d)
    rs = state.rs if state.rs is not None else V.points(spark, d).select("id", "x").limit(0)
    labelled = bfr.kmeans(rs, min(5 * K, max(1, rs.count())), 1)
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


@query()
def op_bfr(spark, d):
    return _rounds(spark, d).labels()


@query()
def op_bfr_round_stats(spark, d):
    return _rounds(spark, d).statistics()


@query()
def op_hierarchical(spark, d):
    return bfr.hierarchical(V.points(spark, d).select("id", "x"), 6.0)
