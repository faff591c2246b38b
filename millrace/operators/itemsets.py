"""Frequent itemsets of baskets, by level-wise joins over flat (basket, item) rows, and by FP-growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.pairs import shared_keys
from millrace.sources.scratch import written


#: FP-growth: baskets that a task sorts into trees, baskets for each tree (a tree is one object of its task), and the most trees.
BASKETS_A_TASK, BASKETS_A_TREE, MOST_TREES = 25_000, 500, 2_000


def basket_rows(df: DataFrame, basket: str, item: str, more_than: int | None = None) -> DataFrame:
    """Distinct (basket, item); with `more_than`, of baskets that have more rows than that before repeated ones go. Nulls are left out."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    if more_than is None:
        return rows.distinct()
    counted = rows.groupBy("basket", "item").agg(F.count("*").alias("n"))
    large = counted.groupBy("basket").agg(F.sum("n").alias("n")).where(F.col("n") > more_than).select("basket")
    return counted.select("basket", "item").join(large, "basket", "left_semi")


def baskets(rows: DataFrame) -> DataFrame:
    """(basket, items): sorted distinct items."""
    return rows.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def prepared(reviews: DataFrame, businesses: DataFrame, state: str) -> DataFrame:
    """(user_id, business_id) of the reviews of businesses in a state."""
    return reviews.select("user_id", "business_id").join(businesses.where(F.col("state") == state).select("business_id"), "business_id").select("user_id", "business_id")


def levels(rows: DataFrame, support: int, most: int):
    """(items, n) of each size from 1 on; a set is only formed of two frequent ones of the same basket. Of rows with a column `part`, each part's own (part, items, n)."""
    part = ["part"] if "part" in rows.columns else []
    singles = written(rows.groupBy(*part, "item").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    yield singles.select(*part, F.array("item").alias("items"), "n")
    held = rows.join(singles.select(*part, "item"), [*part, "item"], "left_semi").select(*part, "basket", F.array("item").alias("items"))
    for size in range(2, most + 1):
        held = written(held)
        left = held.select(*part, "basket", "items", F.slice("items", 1, size - 2).alias("head"), F.col("items")[size - 2].alias("end"))
        right = left.select("basket", "head", F.col("end").alias("last"))
        wide = left.join(right, ["basket", "head"]).where("end < last").select(*part, "basket", F.concat("items", F.array("last")).alias("items"))
        if size < most:
            wide = written(wide)  # read for the counts, and for the next level
        counts = written(wide.groupBy(*part, "items").agg(F.count("*").alias("n")).where(F.col("n") >= support))
        yield counts
        if size == most or not counts.limit(1).count():
            return
        held = wide.join(counts.select(*part, "items"), [*part, "items"], "left_semi")


def parted(rows: DataFrame, parts: int) -> DataFrame:
    """rows and the part of their basket: a hash of the basket, whatever the layout of the table."""
    return rows.withColumn("part", F.pmod(F.conv(F.substring(F.md5(F.col("basket").cast("string").cast("binary")), 1, 6), 16, 10).cast("bigint"), F.lit(parts)))


def local_candidates(rows: DataFrame, support: int, parts: int, most: int = 6) -> DataFrame:
    """(items): first of two passes. Sets that are frequent in at least one part at the part's share of the support; no frequent set is missed."""
    return reduce(DataFrame.unionByName, levels(parted(rows, parts), -(-support // parts), most)).select("items").distinct()


def counted_candidates(rows: DataFrame, sets: DataFrame, support: int) -> DataFrame:
    """(items, n): second pass. The given sets that are in `support` baskets or more."""
    each = sets.select("items", F.explode("items").alias("item"))
    held = each.join(rows, "item").groupBy("items", "basket").agg(F.count("*").alias("k")).where(F.col("k") == F.size("items"))
    return held.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_itemsets(rows: DataFrame, support: int, most: int = 6) -> DataFrame:
    """(items, n) of all sets of 1 to `most` items that are in `support` baskets or more; items is a sorted array. Exact. rows: distinct (basket, item)."""
    return reduce(DataFrame.unionByName, levels(rows, support, most))


def frequent_itemsets_fp(rows: DataFrame, support: int, most: int = 6) -> DataFrame:
    """The same by FP-growth, which holds each basket as one array: for baskets of a bounded size.

    Single items are counted, and trees are grown of the items of frequent pairs only: no other item is in a set of two or more.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = written(rows.select("basket", "item"))
    singles = written(rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    single = singles.select(F.array("item").alias("items"), "n")
    if most < 2:
        return single
    known = written(rows.join(singles.select("item"), "item", "left_semi"))
    paired = written(shared_keys(known, "item", "basket", support).select(F.explode(F.array("a", "b")).alias("item")).distinct())
    held = written(baskets(known.join(paired, "item", "left_semi")).where(F.size("items") > 1))
    if not (n := held.count()):
        return single
    dealt = held.repartition(-(-n // BASKETS_A_TASK))
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n), numPartitions=min(MOST_TREES, -(-n // BASKETS_A_TREE))).fit(dealt).freqItemsets
    return single.unionByName(found.where(F.size("items").between(2, most)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n")))
