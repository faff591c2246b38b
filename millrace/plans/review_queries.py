"""Queries over reviews: filters, explodes, joins, aggregates, top lists, partition reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import itemsets, stats
from millrace.operators.pairs import shared_keys
from millrace.operators.similarity import dense_index
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources.scratch import written

YEAR, TOP = 1998, 10
STOPWORDS = ["the", "a", "and", "of"]
WORDS = f"""words AS (
  SELECT w AS word FROM documents, unnest(regexp_split_to_array(lower(regexp_replace(text, '{C.MARKS}', '', 'g')), '{C.WHITE}')) AS t(w) WHERE w <> '')"""


@query(f"{V.with_(V.REVIEWS)} SELECT count(*) AS n_reviews, count(*) FILTER (year(date) = {YEAR}) AS n_year, count(DISTINCT user_id) AS n_users FROM reviews")
def op_review_summary(spark, d):
    return stats.review_summary(V.reviews(spark, d), YEAR)


@query("SELECT count(*) AS n FROM lineitem")
def op_count(spark, d):
    return V.table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query(f"{V.with_(V.REVIEWS)} SELECT count(DISTINCT user_id) AS n FROM reviews")
def op_count_distinct(spark, d):
    return V.reviews(spark, d).agg(F.count_distinct("user_id").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE year(l_shipdate) = {YEAR}")
def op_year_filter(spark, d):
    items = V.table(spark, d, "lineitem")
    return items.where(C.in_year(items, "l_shipdate", YEAR)).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"{V.with_(V.BUSINESSES)} SELECT business_id, categories FROM businesses WHERE categories IS NOT NULL")
def op_not_null_filter(spark, d):
    return V.businesses(spark, d).where(F.col("categories").isNotNull()).select("business_id", "categories")


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, count(*) AS n FROM reviews GROUP BY 1 HAVING count(*) > 40")
def op_having_gt(spark, d):
    return stats.having_gt(V.reviews(spark, d), "business_id", 40)


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, count(*) AS n FROM reviews GROUP BY 1 HAVING count(*) >= 40")
def op_having_ge(spark, d):
    return stats.having_ge(V.reviews(spark, d), "business_id", 40)


@query(f"{V.with_(V.REVIEWS)} SELECT user_id AS basket, business_id AS item FROM reviews WHERE user_id IN (SELECT user_id FROM reviews GROUP BY 1 HAVING count(*) > 50) GROUP BY 1, 2")
def op_basket_size_filter(spark, d):
    return itemsets.basket_rows(V.reviews(spark, d), "user_id", "business_id", more_than=50)


@query(f"{V.with_(V.BUSINESSES)} SELECT business_id, state FROM businesses WHERE state = (SELECT min(state) FROM businesses)")
def op_state_filter(spark, d):
    found = V.businesses(spark, d)
    return found.join(F.broadcast(found.agg(F.min("state").alias("state"))), "state", "left_semi").select("business_id", "state")


@query(f"{V.with_(WORDS)} SELECT word, count(*) AS n FROM words GROUP BY 1")
def op_explode_words(spark, d):
    return stats.word_rows(V.table(spark, d, "documents")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"{V.with_(WORDS)} SELECT word, count(*) AS n FROM words WHERE word NOT IN ('the', 'a', 'and', 'of') GROUP BY 1")
def op_stopword_anti(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return stats.word_rows(V.table(spark, d, "documents"), stopwords=stop).groupBy("word").agg(F.count("*").alias("n"))


@query(f"{V.with_(V.BUSINESSES)} SELECT business_id, trim(c) AS category FROM businesses, unnest(string_split(categories, ',')) AS t(c) WHERE categories IS NOT NULL")
def op_explode_categories(spark, d):
    return V.businesses(spark, d).where("categories IS NOT NULL").select("business_id", F.explode(C.categories("categories")).alias("category"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, user_id LIMIT {TOP}")
def op_topm_users(spark, d):
    return stats.top_counts(V.reviews(spark, d), "user_id", TOP)


@query(f"{V.with_(WORDS)} SELECT word, count(*) AS n FROM words WHERE word NOT IN ('the', 'a', 'and', 'of') GROUP BY 1 ORDER BY n DESC, word LIMIT {TOP}")
def op_topn_words(spark, d):
    return stats.top_words(V.table(spark, d, "documents"), TOP, stopwords=spark.createDataFrame([(w,) for w in STOPWORDS], "word string"))


@query(
    f"""{V.with_(V.REVIEWS, V.BUSINESSES)} SELECT category, round(avg(stars), 6) AS mean FROM (
  SELECT trim(c) AS category, stars FROM reviews JOIN businesses USING (business_id), unnest(string_split(categories, ',')) AS t(c) WHERE categories IS NOT NULL)
GROUP BY 1 ORDER BY avg(stars) DESC, category LIMIT {TOP}"""
)
def op_topn_categories(spark, d):
    found = stats.top_categories(V.reviews(spark, d), V.businesses(spark, d), TOP)
    return found.select("category", F.round("mean", 6).alias("mean"))


@query(f"{V.with_(V.REVIEWS, V.BUSINESSES)} SELECT user_id, business_id, stars, categories FROM reviews JOIN businesses USING (business_id)")
def op_inner_join(spark, d):
    return V.reviews(spark, d).join(V.businesses(spark, d), "business_id").select("user_id", "business_id", "stars", "categories")


@query(f"{V.with_(V.REVIEWS, V.BUSINESSES)} SELECT user_id, business_id FROM reviews JOIN businesses USING (business_id) WHERE state = 'STANDARD'")
def op_merge_join(spark, d):
    return itemsets.prepared(V.reviews(spark, d), V.businesses(spark, d), "STANDARD")


@query(f"{V.with_(V.REVIEWS, V.RATINGS)} SELECT business_id, categories, n FROM (SELECT CAST(p_partkey AS VARCHAR) AS business_id, CASE WHEN p_size = 1 THEN NULL ELSE p_type || ', ' || p_brand END AS categories FROM part) LEFT JOIN (SELECT business_id, count(*) AS n FROM ratings GROUP BY 1) USING (business_id)")
def op_left_outer_join(spark, d):
    counts = V.ratings(spark, d).groupBy("business_id").agg(F.count("*").alias("n"))
    return V.businesses(spark, d).join(counts, "business_id", "left").select("business_id", "categories", "n")


@query(f"{V.with_(V.REVIEWS, V.USERS)} SELECT user_id, business_id, stars, round(average_stars, 6) AS average_stars FROM reviews JOIN users USING (user_id)")
def op_map_side_lookup(spark, d):
    found = V.reviews(spark, d).join(V.users(spark, d), "user_id")
    return found.select("user_id", "business_id", "stars", F.round("average_stars", 6).alias("average_stars"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, row_number() OVER (ORDER BY substr(md5(user_id), 1, 3), user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM reviews)")
def op_index_lookup(spark, d):
    return dense_index(V.reviews(spark, d), "user_id")


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, count(*) AS n, CAST(sum(stars) AS DOUBLE) AS total, round(avg(stars), 6) AS mean FROM reviews GROUP BY 1")
def op_group_avg(spark, d):
    return V.reviews(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("stars").alias("total"), F.round(F.avg("stars"), 6).alias("mean"))


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, count(*) AS n FROM reviews GROUP BY 1")
def op_group_count(spark, d):
    return V.reviews(spark, d).groupBy("business_id").agg(F.count("*").alias("n"))


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, CAST(sum(stars) AS DOUBLE) AS total FROM reviews GROUP BY 1")
def op_group_sum(spark, d):
    return V.reviews(spark, d).groupBy("business_id").agg(F.sum("stars").alias("total"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, array_to_string(list(business_id ORDER BY business_id, okey, line), ',') AS items FROM reviews GROUP BY 1")
def op_collect_list(spark, d):
    return V.reviews(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("business_id")), ",").alias("items"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, array_to_string(list(DISTINCT business_id ORDER BY business_id), ',') AS items FROM reviews GROUP BY 1")
def op_collect_set(spark, d):
    return V.reviews(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("business_id")), ",").alias("items"))


@query(f"{V.with_(V.REVIEWS)} SELECT DISTINCT user_id, business_id FROM reviews")
def op_distinct(spark, d):
    return V.visits(spark, d)


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, min(user_id) AS user_id FROM reviews GROUP BY 1")
def op_distinct_by_key(spark, d):
    return V.reviews(spark, d).groupBy("business_id").agg(F.min("user_id").alias("user_id"))


@query(f"{V.with_(V.REVIEWS, V.RATINGS)} SELECT user_id, business_id, stars FROM ratings")
def op_first_per_key(spark, d):
    return V.ratings(spark, d)


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, business_id LIMIT 1")
def op_argmax(spark, d):
    counts = V.reviews(spark, d).groupBy("business_id").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(F.struct("business_id", "n"), F.struct(-F.col("n"), "business_id")).alias("best")).select("best.business_id", "best.n")


@query(f"{V.with_(V.REVIEWS, V.RATINGS)} SELECT user_id, round(avg(stars), 6) AS mean FROM ratings GROUP BY 1")
def op_driver_avg(spark, d):
    return V.ratings(spark, d).groupBy("user_id").agg(F.round(F.avg("stars"), 6).alias("mean"))


@query(f"{V.with_(V.REVIEWS)} SELECT part, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS part) LEFT JOIN (SELECT ascii(business_id) % 10 AS part, count(*) AS n FROM reviews GROUP BY 1) USING (part)")
def op_partition_count(spark, d):
    return stats.partition_report(stats.dealt_by_first_character(V.reviews(spark, d).select("business_id"), "business_id", 10), 10)


@query(f"{V.with_(V.REVIEWS)} SELECT business_id, count(*) AS n FROM reviews GROUP BY 1 HAVING count(*) > 40")
def op_partitioned_having(spark, d):
    return stats.having_gt(stats.dealt_by_first_character(V.reviews(spark, d).select("business_id"), "business_id", 10), "business_id", 40)


@query(f"SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE CAST('0x' || substr(md5('0:' || vec_id), 1, 7) AS BIGINT) < {int(0.8 * (1 << 28))}")
def op_sample(spark, d):
    return stats.hash_sample(V.points(spark, d), "id", 0.8).select("id", "label")


@query(f"{V.with_(V.REVIEWS, V.VISITS)} SELECT x.user_id AS a, y.user_id AS b, count(*) AS n FROM visits x JOIN visits y ON x.business_id = y.business_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 4")
def op_pairs(spark, d):
    return shared_keys(written(V.visits(spark, d)), "user_id", "business_id", 4)


@query(f"{V.with_(V.REVIEWS, V.VISITS)} SELECT x.business_id, x.user_id AS a, y.user_id AS b FROM visits x JOIN visits y ON x.business_id = y.business_id AND x.user_id < y.user_id")
def op_self_join_pairs(spark, d):
    rows = V.visits(spark, d)
    return rows.select("business_id", F.col("user_id").alias("a")).join(rows.select("business_id", F.col("user_id").alias("b")), "business_id").where("a < b").select("business_id", "a", "b")


@query(
    """SELECT c_custkey, round(abs(c_acctbal), 6) AS magnitude, round(sqrt(abs(c_acctbal)), 6) AS root, round(power(c_acctbal / 100, 2), 6) AS square,
  least(greatest(c_acctbal / 1000, 1.0), 5.0) AS clamped, floor(c_acctbal + 0.5) AS whole, least(c_nationkey, 12) AS low, greatest(c_nationkey, 12) AS high FROM customer"""
)
def op_scalar_numeric(spark, d):
    x = F.col("c_acctbal")
    return V.table(spark, d, "customer").select(
        "c_custkey", F.round(F.abs(x), 6).alias("magnitude"), F.round(F.sqrt(F.abs(x)), 6).alias("root"), F.round(F.pow(x / 100, F.lit(2)), 6).alias("square"), C.clamped(x / 1000, 1.0, 5.0).alias("clamped"), F.floor(x + 0.5).cast("double").alias("whole"), F.least("c_nationkey", F.lit(12)).alias("low"),
        F.greatest("c_nationkey", F.lit(12)).alias("high"),
    )


@query(
    f"""SELECT doc_id, lower(substr(text, 1, 40)) AS head, regexp_replace(text, '{C.MARKS}', '', 'g') AS bare,
  len(list_filter(regexp_split_to_array(lower(regexp_replace(text, '{C.MARKS}', '', 'g')), '{C.WHITE}'), lambda w: w <> '')) AS n_words, replace(text, chr(10), ' ') AS line FROM documents"""
)
def op_scalar_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.lower(F.substring("text", 1, 40)).alias("head"), F.regexp_replace("text", C.MARKS, "").alias("bare"), F.when(F.col("text").isNotNull(), F.size(C.words("text"))).cast("bigint").alias("n_words"), F.regexp_replace("text", "\n", " ").alias("line"))


@query("SELECT p_partkey, CAST((7 * p_partkey + 3) % 101 AS BIGINT) AS h FROM part")
def op_linear_hash(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.linear_hash(F.col("p_partkey"), 7, 3, 101).cast("bigint").alias("h"))


@query("SELECT n AS prime FROM (SELECT unnest(range(2, 542)) AS n) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 24)) AS k) WHERE k < n AND n % k = 0)")
def op_primes(spark, d):
    return spark.createDataFrame([(p,) for p in C.primes(100)], "prime bigint")


@query(
    """WITH u AS (SELECT DISTINCT l_orderkey AS basket, CAST(l_suppkey AS VARCHAR) AS item FROM lineitem)
SELECT x.basket, x.item || ',' || y.item || ',' || z.item AS items FROM u x JOIN u y ON x.basket = y.basket AND x.item < y.item JOIN u z ON y.basket = z.basket AND y.item < z.item"""
)
def op_combinations(spark, d):
    return itemsets.baskets(V.order_baskets(spark, d)).select("basket", F.explode(C.subsets("items", 3)).alias("s")).select("basket", F.array_join("s", ",").alias("items"))


@query("SELECT doc_id, array_to_string(flatten([string_split(source, '-'), [lang]]), ',') AS parts FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def op_flatten(spark, d):
    return V.table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.array_join(F.flatten(F.array(F.split("source", "-"), F.array("lang"))), ",").alias("parts"))
