"""Writers of the supported layouts. All but the one-document forms stay distributed; those hold bounded lists only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """With a header and without an index."""
    df.write.mode("overwrite").csv(path, header=True)


def csv_one_header(df: DataFrame, path: str) -> None:
    """With one header in all, as a file of its own beside the rows, which stay in as many files as there are tasks."""
    df.write.mode("overwrite").csv(path, header=False)
    names = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"`{c}` string" for c in df.columns))
    names.coalesce(1).write.mode("append").csv(path, header=False)


def text_lines(lines: DataFrame, path: str) -> None:
    """The column `line`, in the order of the columns after it, as text files whose names sort alike."""
    order = [c for c in lines.columns if c != "line"]
    (lines.orderBy(*order) if order else lines).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object as the file at `path`, on any file system that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()


def community_lines(members: DataFrame, community: str = "community", vertex: str = "id") -> DataFrame:
    """(line, length): the sorted members of each community, quoted and joined; order by length, then line."""
    line = F.array_join(F.transform(F.array_sort(F.collect_set(vertex)), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    return members.groupBy(community).agg(line.alias("line")).select(F.length("line").alias("length"), "line")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """(line, and what orders it): ('u', 'v'), value by falling value."""
    line = F.format_string("('%s', '%s'), %s", "src", "dst", F.col("betweenness").cast("string"))
    return edges.select(line.alias("line"), (-F.col("betweenness")).alias("by"), "src", "dst")


def label_lines(labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(line): one {"id": label} object for each row."""
    return labels.select(F.to_json(F.create_map(F.col(id_col).cast("string"), F.col(label_col))).alias("line"))
