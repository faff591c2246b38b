"""A folder of chunk files as a stream: each file is one round of chunked clustering, or one increment of running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.bfr import Rounds


def point_stream(spark: SparkSession, folder: str, dims: int) -> DataFrame:
    """(id, x) of headerless `id,x0,x1,...` files, one file a micro-batch."""
    names = [f"x{i}" for i in range(dims)]
    rows = spark.readStream.schema("id string, " + ", ".join(f"{n} double" for n in names)).option("maxFilesPerTrigger", 1).csv(folder)
    return rows.select("id", F.array(*names).alias("x"))


def cluster_stream(spark: SparkSession, folder: str, k: int, dims: int, seed: int = 1, checkpoint: str | None = None) -> Rounds:
    """Clusters what the folder holds now, file by file, and returns the state."""
    state = Rounds(spark, k, dims, seed)
    writer = point_stream(spark, folder, dims).writeStream.trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(lambda df, _: state.add(df)).start()
    query.awaitTermination()
    return state


def review_counts(stream: DataFrame, watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, business_id, n, total) of a stream of reviews with a timestamp column `date`: tumbling windows that close when the watermark has passed."""
    windows = stream.withWatermark("date", watermark).groupBy(F.window("date", width), "business_id")
    return windows.agg(F.count("*").alias("n"), F.sum("stars").alias("total")).select(F.col("window.start").alias("start"), "business_id", "n", "total")
