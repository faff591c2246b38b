"""The library's inputs as views of the test tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.itemsets import basket_rows
from millrace.operators.recommend import first_ratings

#: Order of a pair's ratings; rows that are equal in all of these have the same stars.
FIRST = ["date", "okey", "line", "supp"]
DIMS = 64


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, business_id, stars, date, okey, line, supp, amount): a line item is a customer's rating of a part."""
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_partkey").cast("string").alias("business_id"), (((F.col("l_quantity").cast("int") - 1) % 5) + 1).cast("double").alias("stars"), F.col("l_shipdate").alias("date"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp")
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").cast("string").alias("user_id"))
    return items.join(orders, "okey").select("user_id", "business_id", "stars", "date", "okey", "line", "supp")


def businesses(spark: SparkSession, d: str) -> DataFrame:
    """(business_id, categories, state)."""
    named = F.when(F.col("p_size") == 1, None).otherwise(F.concat("p_type", F.lit(", "), "p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("business_id"), named.alias("categories"), F.col("p_type").alias("state"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, average_stars)."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), (1 + 4 * (F.col("c_acctbal") + 1000) / 11000).alias("average_stars"))


def training(spark: SparkSession, d: str) -> DataFrame:
    """First ratings of the training reviews."""
    return first_ratings(reviews(spark, d).where("(okey + line) % 5 <> 0"), FIRST)


def truth(spark: SparkSession, d: str) -> DataFrame:
    """First ratings of the other reviews."""
    return first_ratings(reviews(spark, d).where("(okey + line) % 5 = 0"), FIRST)


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return first_ratings(reviews(spark, d), FIRST)


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (user_id, business_id)."""
    return reviews(spark, d).select("user_id", "business_id").distinct()


def order_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (basket, item): suppliers of an order."""
    return basket_rows(table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_suppkey").cast("string").alias("supplier")), "l_orderkey", "supplier")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, label): embeddings."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("label"))


REVIEWS = """reviews AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS business_id, CAST((CAST(l_quantity AS INTEGER) - 1) % 5 + 1 AS DOUBLE) AS stars,
    l_shipdate AS date, l_orderkey AS okey, l_linenumber AS line, l_suppkey AS supp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BUSINESSES = """businesses AS (
  SELECT CAST(p_partkey AS VARCHAR) AS business_id, CASE WHEN p_size = 1 THEN NULL ELSE p_type || ', ' || p_brand END AS categories, p_type AS state FROM part)"""
USERS = "users AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 1 + 4 * (c_acctbal + 1000) / 11000 AS average_stars FROM customer)"
VISITS = "visits AS (SELECT DISTINCT user_id, business_id FROM reviews)"
ORDER_BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS basket, CAST(l_suppkey AS VARCHAR) AS item FROM lineitem)"
POINTS = "points AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS t(i))"


def first(name: str, where: str = "true") -> str:
    """A table expression of first ratings."""
    return f"""{name} AS (
  SELECT user_id, business_id, stars FROM reviews WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY user_id, business_id ORDER BY date, okey, line, supp, stars) = 1)"""


TRAINING, TRUTH, RATINGS = first("training", "(okey + line) % 5 <> 0"), first("truth", "(okey + line) % 5 = 0"), first("ratings")


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)
