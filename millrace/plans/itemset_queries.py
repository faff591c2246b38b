"""Queries over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import itemsets
from millrace.plans import views as V
from millrace.plans.registry import query

SUPPORT = 30
#: A support at which sets of three and more items are found also where items are many.
LOW_SUPPORT = 4
MOST = 6


def _level(table: str, size: int, least: int, part: str = "") -> str:
    """SQL of the sets of one size, of each part if there are any."""
    items = [f"x{i}.item" for i in range(size)]
    joins = "".join(f" JOIN {table} x{i} ON x{i - 1}.basket = x{i}.basket AND x{i - 1}.item < x{i}.item" for i in range(1, size))
    return f"SELECT {" || ',' || ".join(items)} AS items, {size} AS size, count(*) AS n FROM {table} x0{joins} GROUP BY {part}{', '.join(items)} HAVING count(*) >= {least}"


def _sets(support: int) -> str:
    return f"sets AS ({' UNION ALL '.join(_level('baskets', n, support) for n in range(1, MOST + 1))})"


SETS = _sets(SUPPORT)


def shown(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"), "n")


@query(f"{V.with_(V.REVIEWS, V.VISITS)} SELECT user_id AS basket, array_to_string(list(business_id ORDER BY business_id), ',') AS items FROM visits GROUP BY 1")
def op_baskets_case1(spark, d):
    return itemsets.baskets(itemsets.basket_rows(V.reviews(spark, d), "user_id", "business_id")).select("basket", F.array_join("items", ",").alias("items"))


@query(f"{V.with_(V.REVIEWS, V.VISITS)} SELECT business_id AS basket, array_to_string(list(user_id ORDER BY user_id), ',') AS items FROM visits GROUP BY 1")
def op_baskets_case2(spark, d):
    return itemsets.baskets(itemsets.basket_rows(V.reviews(spark, d), "business_id", "user_id")).select("basket", F.array_join("items", ",").alias("items"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id AS basket, array_to_string(list(DISTINCT business_id ORDER BY business_id), ',') AS items FROM reviews GROUP BY 1 HAVING count(*) > 50")
def op_qualified_baskets(spark, d):
    return itemsets.baskets(itemsets.basket_rows(V.reviews(spark, d), "user_id", "business_id", more_than=50)).select("basket", F.array_join("items", ",").alias("items"))


@query(f"{V.with_(V.REVIEWS, V.BUSINESSES)} SELECT user_id, business_id FROM reviews JOIN businesses USING (business_id) WHERE state = 'PROMO'")
def op_basket_preparation(spark, d):
    return itemsets.prepared(V.reviews(spark, d), V.businesses(spark, d), "PROMO")


@query(f"{V.with_(V.ORDER_BASKETS, SETS)} SELECT items, size, n FROM sets")
def op_frequent_itemsets(spark, d):
    return shown(itemsets.frequent_itemsets(V.order_baskets(spark, d), SUPPORT, MOST))


@query(f"{V.with_(V.ORDER_BASKETS, SETS)} SELECT items, size, n FROM sets")
def op_frequent_itemsets_fp(spark, d):
    return shown(itemsets.frequent_itemsets_fp(V.order_baskets(spark, d), SUPPORT, MOST))


@query(f"{V.with_(V.ORDER_BASKETS, SETS)} SELECT items, size, n FROM sets ORDER BY size, items")
def op_itemset_order(spark, d):
    found = itemsets.frequent_itemsets(V.order_baskets(spark, d), SUPPORT, MOST)
    return shown(found.orderBy(F.size("items"), "items"))


@query(f"{V.with_(V.ORDER_BASKETS, _sets(LOW_SUPPORT))} SELECT items, size, n FROM sets")
def op_frequent_itemsets_low(spark, d):
    return shown(itemsets.frequent_itemsets(V.order_baskets(spark, d), LOW_SUPPORT, MOST))


PARTS = 4
_PARTED = f"parted AS (SELECT basket, item, CAST(('0x' || substr(md5(CAST(basket AS VARCHAR)), 1, 6)) AS BIGINT) % {PARTS} AS part FROM baskets)"
_CANDIDATES = f"candidates AS ({' UNION ALL '.join(_level('parted', n, -(-SUPPORT // PARTS), 'x0.part, ') for n in range(1, MOST + 1))})"


@query(f"{V.with_(V.ORDER_BASKETS, _PARTED, _CANDIDATES)} SELECT DISTINCT items FROM candidates")
def op_son_pass1(spark, d):
    return itemsets.local_candidates(V.order_baskets(spark, d), SUPPORT, PARTS, MOST).select(F.array_join("items", ",").alias("items"))


@query(f"{V.with_(V.ORDER_BASKETS, SETS)} SELECT items, size, n FROM sets")
def op_son_pass2(spark, d):
    rows = V.order_baskets(spark, d)
    return shown(itemsets.counted_candidates(rows, itemsets.local_candidates(rows, SUPPORT, PARTS, MOST), SUPPORT))


@query(f"{V.with_(V.ORDER_BASKETS, SETS)} SELECT basket, item FROM baskets WHERE item IN (SELECT items FROM sets WHERE size = 1)")
def op_semi_membership(spark, d):
    rows = V.order_baskets(spark, d)
    frequent = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    return rows.join(frequent, "item", "left_semi").select("basket", "item")
