"""Counts, top lists and averages over reviews, and how rows are dealt over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C


def review_summary(reviews: DataFrame, year: int, date: str = "date", user: str = "user_id") -> DataFrame:
    """One row: n_reviews, n_year and n_users (distinct, null not counted). All from one scan."""
    return reviews.agg(F.count("*").alias("n_reviews"), F.count(F.when(C.in_year(reviews, date, year), 1)).alias("n_year"), F.count_distinct(user).alias("n_users"))


def top_counts(df: DataFrame, key: str, most: int, name: str = "n") -> DataFrame:
    """(key, n) of the `most` most frequent keys; of ties, the smaller key. Null keys are left out."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return counts.orderBy(F.desc(name), key).limit(most)


def word_rows(df: DataFrame, text: str = "text", stopwords: DataFrame | None = None, word: str = "word") -> DataFrame:
    """(word) for each word of each text that is no stop word (distinct `word` column)."""
    out = df.select(F.explode(C.words(text)).alias(word))
    return out if stopwords is None else out.join(stopwords.select(F.lower("word").alias(word)).distinct(), word, "left_anti")


def top_words(df: DataFrame, most: int, text: str = "text", stopwords: DataFrame | None = None) -> DataFrame:
    """(word, n): words are counted first and stop words are taken out of the counts, so the join is over the vocabulary."""
    counts = df.select(F.explode(C.words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if stopwords is not None:
        counts = counts.join(stopwords.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    return counts.orderBy(F.desc("n"), "word").limit(most)


def category_rows(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """(category, n, total): review counts and sums of stars; a business counts in each category as often as it names it. Businesses without categories are left out."""
    stars = reviews.groupBy("business_id").agg(F.count("stars").alias("n"), F.sum("stars").alias("total"))
    named = businesses.where(F.col("categories").isNotNull()).select("business_id", F.explode(C.categories("categories")).alias("category"))
    return stars.join(named, "business_id").select("category", "n", "total")


def top_categories(reviews: DataFrame, businesses: DataFrame, most: int) -> DataFrame:
    """(category, mean) of the `most` best categories by mean stars; of ties, the first by name.

    Reviews are summed up by business before the join, so that what is joined and exploded has a row for each business, however many reviews it has.
    """
    means = category_rows(reviews, businesses).groupBy("category").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.where("mean IS NOT NULL").orderBy(F.desc("mean"), "category").limit(most)


def having_gt(df: DataFrame, key: str, least: int, name: str = "n") -> DataFrame:
    """(key, n) with a count above `least` (strict)."""
    return df.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > least)


def having_ge(df: DataFrame, key: str, least: int, name: str = "n") -> DataFrame:
    """(key, n) with a count of `least` or more."""
    return df.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) >= least)


def dealt_by_first_character(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """df over so many partitions: the code of the key's first character (0 for null and empty keys) modulo their number. Few characters make few, uneven partitions: a layout for reports, not for joins."""
    return df.repartitionById(partitions, F.pmod(F.coalesce(F.ascii(key), F.lit(0)), F.lit(partitions)))


def partition_report(df: DataFrame, partitions: int) -> DataFrame:
    """(part, n) for each partition from 0 to partitions - 1, empty ones too."""
    counts = df.groupBy(F.spark_partition_id().cast("bigint").alias("part")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(partitions).withColumnRenamed("id", "part")
    return every.join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About that share of the rows, chosen by a hash of their key: the same rows however the table is dealt out, in one pass. Null keys are left out."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 7), 16, 10).cast("bigint")
    return df.where(place < int(fraction * (1 << 28)))
