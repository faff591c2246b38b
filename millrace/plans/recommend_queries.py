"""Queries of similarity, rating prediction and its errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import primes
from millrace.operators import recommend, similarity
from millrace.operators.pairs import shared_keys
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources.scratch import written

CORATED, NEAREST, JACCARD = 3, 3, 0.08
HASHES, UNIVERSE = 20, 1 << 20
PEARSON = f"""means AS (SELECT business_id, avg(stars) AS mean FROM training GROUP BY 1),
shared AS (
  SELECT x.business_id AS b1, y.business_id AS b2, count(*) AS n, sum((x.stars - a.mean) * (y.stars - b.mean)) AS top, sum((x.stars - a.mean) * (x.stars - a.mean)) AS wide1, sum((y.stars - b.mean) * (y.stars - b.mean)) AS wide2
  FROM training x JOIN training y ON x.user_id = y.user_id AND x.business_id < y.business_id JOIN means a ON a.business_id = x.business_id JOIN means b ON b.business_id = y.business_id
  GROUP BY 1, 2 HAVING count(*) >= {CORATED}),
model AS (SELECT b1, b2, CASE WHEN wide1 > 1e-9 AND wide2 > 1e-9 THEN top / sqrt(wide1 * wide2) ELSE 0.0 END AS sim FROM shared)"""
PREDICTED = f"""near AS (SELECT b1 AS item, b2 AS other, round(sim, 6) AS sim FROM model UNION SELECT b2, b1, round(sim, 6) FROM model),
rated AS (
  SELECT t.user_id, t.business_id, near.sim, r.stars, row_number() OVER (PARTITION BY t.user_id, t.business_id ORDER BY near.sim DESC, near.other) AS rank
  FROM (SELECT DISTINCT user_id, business_id FROM truth) t JOIN near ON near.item = t.business_id JOIN training r ON r.user_id = t.user_id AND r.business_id = near.other),
found AS (SELECT user_id, business_id, CASE WHEN sum(abs(sim)) > 0 THEN sum(sim * stars) / sum(abs(sim)) ELSE 1.0 END AS stars FROM rated WHERE rank <= {NEAREST} GROUP BY 1, 2),
mean AS (SELECT user_id, avg(stars) AS mean FROM training GROUP BY 1),
p1 AS (
  SELECT t.user_id, t.business_id, CASE WHEN mean IS NOT NULL THEN greatest(coalesce(found.stars, mean), 1.0) END AS stars
  FROM (SELECT DISTINCT user_id, business_id FROM truth) t LEFT JOIN found USING (user_id, business_id) LEFT JOIN mean USING (user_id))"""
#: A second prediction that SQL can state: the item's mean.
SECOND = "p2 AS (SELECT t.user_id, t.business_id, m.mean AS stars FROM (SELECT DISTINCT user_id, business_id FROM truth) t JOIN (SELECT business_id, avg(stars) AS mean FROM training GROUP BY 1) m USING (business_id))"
BLENDED = """blend AS (
  SELECT p1.user_id, p1.business_id, CASE WHEN average_stars > 4.1 THEN least(greatest(p1.stars, p2.stars) + 0.4, 5.0) WHEN average_stars <= 2.0 THEN least(p1.stars, p2.stars) ELSE 0.4 * p1.stars + 0.6 * p2.stars END AS stars
  FROM p1 JOIN p2 USING (user_id, business_id) JOIN users USING (user_id))"""
_BASE = V.with_(V.REVIEWS, V.TRAINING, V.TRUTH)


def _train(spark, d):
    """The training ratings as a table of their own: models and predictions read them several times."""
    return written(V.training(spark, d))


def _model(train):
    return recommend.pearson(train, CORATED).withColumn("sim", F.round("sim", 6))


def _first(spark, d, train):
    return recommend.predicted(V.truth(spark, d), train, _model(train), NEAREST)


def _second(spark, d, train):
    means = train.groupBy("business_id").agg(F.avg("stars").alias("stars"))
    return V.truth(spark, d).select("user_id", "business_id").join(means, "business_id")


def _blend(spark, d):
    train = _train(spark, d)
    return recommend.blended(_first(spark, d, train), _second(spark, d, train), V.users(spark, d))


@query(f"{_BASE} SELECT x.business_id AS a, y.business_id AS b, count(*) AS n FROM training x JOIN training y ON x.user_id = y.user_id AND x.business_id < y.business_id GROUP BY 1, 2 HAVING count(*) >= {CORATED}")
def op_corated_pairs(spark, d):
    return recommend.corated_pairs(_train(spark, d), CORATED)


@query(
    f"""{_BASE} SELECT x.business_id AS a, y.business_id AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * y.stars) AS sxy
FROM training x JOIN training y ON x.user_id = y.user_id AND x.business_id < y.business_id GROUP BY 1, 2 HAVING count(*) >= {CORATED}"""
)
def op_dict_intersection(spark, d):
    return shared_keys(_train(spark, d), "business_id", "user_id", CORATED, "stars").select("a", "b", "n", "sx", "sy", "sxy")


@query(f"{_BASE}, {PEARSON} SELECT b1, b2, round(sim, 6) + 0.0 AS sim FROM model")
def op_pearson_sim(spark, d):
    return _model(_train(spark, d)).withColumn("sim", F.col("sim") + 0.0)


@query(f"{_BASE}, {PEARSON} SELECT b1, b2, round(sim, 6) AS sim FROM model WHERE sim >= 0.5")
def op_similarity_filter(spark, d):
    return recommend.pearson(_train(spark, d), CORATED).where("sim >= 0.5").withColumn("sim", F.round("sim", 6))


@query(f"{_BASE}, {PEARSON}, {PREDICTED} SELECT item, other, sim + 0.0 AS sim FROM near")
def op_symmetrize(spark, d):
    return recommend.neighbours(_model(_train(spark, d))).withColumn("sim", F.col("sim") + 0.0)


@query(f"{_BASE}, {PEARSON}, {PREDICTED} SELECT user_id, business_id, sim + 0.0 AS sim, stars, rank FROM rated WHERE rank <= {NEAREST}")
def op_topn_neighbours(spark, d):
    from pyspark.sql import Window as W

    train = _train(spark, d)
    near = recommend.neighbours(_model(train))
    rated = V.truth(spark, d).select("user_id", F.col("business_id").alias("item")).join(near, "item").join(train.withColumnRenamed("business_id", "other"), ["user_id", "other"])
    rank = F.row_number().over(W.partitionBy("user_id", "item").orderBy(F.desc("sim"), "other")).cast("bigint")
    return rated.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("user_id", F.col("item").alias("business_id"), (F.col("sim") + 0.0).alias("sim"), "stars", "rank")


@query(f"{_BASE}, {PEARSON}, {PREDICTED} SELECT user_id, business_id, round(stars, 6) AS stars FROM p1")
def op_predict_topn(spark, d):
    return _first(spark, d, _train(spark, d)).withColumn("stars", F.round("stars", 6))


@query()
def op_als(spark, d):
    return recommend.als_predicted(V.truth(spark, d), _train(spark, d))


@query()
def op_als_blend(spark, d):
    train = _train(spark, d)
    return recommend.blended(recommend.als_predicted(V.truth(spark, d), train), _first(spark, d, train), V.users(spark, d))


@query(f"{_BASE}, {V.USERS}, {PEARSON}, {PREDICTED}, {SECOND}, {BLENDED} SELECT user_id, business_id, round(stars, 6) AS stars FROM blend")
def op_blend(spark, d):
    return _blend(spark, d).withColumn("stars", F.round("stars", 6))


@query(f"{_BASE}, {PEARSON}, {PREDICTED} SELECT p1.user_id, p1.business_id, round(p1.stars, 6) AS p, t.stars AS t FROM p1 JOIN truth t USING (user_id, business_id)")
def op_prediction_align(spark, d):
    return recommend.aligned(_first(spark, d, _train(spark, d)), V.truth(spark, d)).select("user_id", "business_id", F.round("p", 6).alias("p"), "t")


_ERRORS = "SELECT count(*) AS n, round(sqrt(avg(power(p1.stars - t.stars, 2))), 6) AS rmse, count(*) FILTER (t.stars IN (1, 2, 5)) AS n_only, round(sqrt(avg(power(p1.stars - t.stars, 2)) FILTER (t.stars IN (1, 2, 5))), 6) AS rmse_only"


@query(f"{_BASE}, {PEARSON}, {PREDICTED} {_ERRORS} FROM p1 JOIN truth t USING (user_id, business_id)")
def op_rmse(spark, d):
    out = recommend.errors(_first(spark, d, _train(spark, d)), V.truth(spark, d))
    return out.select("n", F.round("rmse", 6).alias("rmse"), "n_only", F.round("rmse_only", 6).alias("rmse_only"))


@query(f"{_BASE}, {V.USERS}, {PEARSON}, {PREDICTED}, {SECOND}, {BLENDED} {_ERRORS.replace('p1.', 'blend.')} FROM blend JOIN truth t USING (user_id, business_id)")
def op_rmse_125(spark, d):
    out = recommend.errors(_blend(spark, d), V.truth(spark, d))
    return out.select("n", F.round("rmse", 6).alias("rmse"), "n_only", F.round("rmse_only", 6).alias("rmse_only"))


_SIZES = "sizes AS (SELECT business_id, count(*) AS size FROM visits GROUP BY 1)"
_SHARED = "shared AS (SELECT x.business_id AS a, y.business_id AS b, count(*) AS n FROM visits x JOIN visits y ON x.user_id = y.user_id AND x.business_id < y.business_id GROUP BY 1, 2)"


@query(
    f"""{V.with_(V.REVIEWS, V.VISITS, _SIZES, _SHARED)} SELECT a, b, round(n / (sa.size + sb.size - n), 6) AS sim
FROM shared JOIN sizes sa ON sa.business_id = a JOIN sizes sb ON sb.business_id = b WHERE n / (sa.size + sb.size - n) >= {JACCARD}"""
)
def op_jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(written(V.visits(spark, d)), "business_id", "user_id", JACCARD).withColumn("sim", F.round("sim", 6))


@query(
    f"""{V.with_(V.REVIEWS, V.VISITS, _SIZES, _SHARED)} SELECT a, b, round(n / greatest(sa.size, sb.size), 6) AS sim
FROM shared JOIN sizes sa ON sa.business_id = a JOIN sizes sb ON sb.business_id = b WHERE n / greatest(sa.size, sb.size) >= 0.15"""
)
def op_overlap_draft(spark, d):
    return similarity.overlap_pairs(written(V.visits(spark, d)), "business_id", "user_id", 0.15).withColumn("sim", F.round("sim", 6))


_NUMBERS = "family AS (SELECT unnest([" + ", ".join(map(str, primes(HASHES))) + f"]) AS p, unnest(range({HASHES})) AS i)"
_SIGNED = f"signed AS (SELECT business_id, i, min((p * CAST(user_id AS BIGINT) + i) % {UNIVERSE}) AS h FROM visits, family GROUP BY 1, 2)"


@query(f"{V.with_(V.REVIEWS, V.VISITS, _NUMBERS, _SIGNED)} SELECT business_id, array_to_string(list(h ORDER BY i), ',') AS signature FROM signed GROUP BY 1")
def op_minhash_signature(spark, d):
    rows = V.visits(spark, d).withColumn("idx", F.col("user_id").cast("bigint"))
    return similarity.signatures(rows, "business_id", "idx", UNIVERSE, HASHES).select("business_id", F.array_join("signature", ",").alias("signature"))


_BANDS = "banded AS (SELECT business_id, i // 2 AS band, array_to_string(list(h ORDER BY h), ',') AS part FROM signed GROUP BY 1, 2)"


@query(f"{V.with_(V.REVIEWS, V.VISITS, _NUMBERS, _SIGNED, _BANDS)} SELECT business_id, band, part FROM banded")
def op_lsh_bands(spark, d):
    rows = V.visits(spark, d).withColumn("idx", F.col("user_id").cast("bigint"))
    banded = similarity.bands(similarity.signatures(rows, "business_id", "idx", UNIVERSE, HASHES), "business_id", HASHES // 2, 2)
    return banded.select("business_id", F.col("band").cast("bigint").alias("band"), F.array_join("part", ",").alias("part"))


@query(f"{V.with_(V.REVIEWS, V.VISITS, _NUMBERS, _SIGNED, _BANDS)} SELECT DISTINCT x.business_id AS a, y.business_id AS b FROM banded x JOIN banded y ON x.band = y.band AND x.part = y.part AND x.business_id < y.business_id")
def op_lsh_bucket_join(spark, d):
    rows = V.visits(spark, d).withColumn("idx", F.col("user_id").cast("bigint"))
    return similarity.bucket_pairs(similarity.bands(similarity.signatures(rows, "business_id", "idx", UNIVERSE, HASHES), "business_id", HASHES // 2, 2), "business_id")


LSH_BANDS, LSH_ROWS = 50, 2
_FAMILY = similarity.family(LSH_BANDS * LSH_ROWS, 1)
_INDEXED = "indexed AS (SELECT user_id, row_number() OVER (ORDER BY substr(md5(user_id), 1, 3), user_id) - 1 AS idx, count(*) OVER () AS universe FROM (SELECT DISTINCT user_id FROM visits))"
_LSH = f"""family AS (SELECT unnest([{", ".join(map(str, _FAMILY))}]) AS p, unnest(range({len(_FAMILY)})) AS i),
signed AS (SELECT business_id, i, min((p * idx + i) % universe) AS h FROM visits JOIN indexed USING (user_id), family GROUP BY 1, 2),
banded AS (SELECT business_id, i // {LSH_ROWS} AS band, list(h ORDER BY h) AS part FROM signed GROUP BY 1, 2),
near AS (SELECT DISTINCT x.business_id AS a, y.business_id AS b FROM banded x JOIN banded y ON x.band = y.band AND x.part = y.part AND x.business_id < y.business_id)"""


@query(
    f"""{V.with_(V.REVIEWS, V.VISITS, _SIZES, _SHARED, _INDEXED, _LSH)} SELECT a, b, round(n / (sa.size + sb.size - n), 6) AS sim
FROM shared JOIN near USING (a, b) JOIN sizes sa ON sa.business_id = a JOIN sizes sb ON sb.business_id = b WHERE n / (sa.size + sb.size - n) >= {JACCARD}"""
)
def op_lsh_jaccard_pairs(spark, d):
    return similarity.lsh_jaccard_pairs(written(V.visits(spark, d)), "business_id", "user_id", JACCARD, LSH_BANDS, LSH_ROWS, seed=1).withColumn("sim", F.round("sim", 6))
