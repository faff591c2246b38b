"""Numbers in place of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of dense_index(); their counts are the only rows that meet in one task.
INDEX_BUCKETS = 4096


def dense_index(df: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """(column, idx): numbers from 0 without gaps for the distinct non-null values. Values are ranked in buckets by a hash, and buckets are offset by the counts before them, so no task sorts all values."""
    named = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("bucket", F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 3), 16, 10).cast("int"))
    before = named.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy(column)) - 1)
    return ranked.join(F.broadcast(before), "bucket").select(column, (F.col("rank") + F.col("before")).cast("bigint").alias(index))
