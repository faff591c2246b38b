"""Readers of the supported inputs: JSON lines, CSV with and without a header, Parquet, word files, folders of chunk files, label documents.

Schemas are always declared, so a scan reads its input once and only the columns that a query uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string"
USER = "user_id string, average_stars double"
RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"
MODEL = "b1 string, b2 string, sim double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line. Fields that a line lacks are null; a line that is no JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def csv_header(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """CSV whose first line names the columns."""
    return spark.read.schema(schema).csv(path, header=True)


def csv_plain(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """CSV without a header: a first line of names becomes a row."""
    return spark.read.schema(schema).csv(path, header=False)


def csv_without(spark: SparkSession, path: str, line: str, schema: str = PAIR) -> DataFrame:
    """CSV without every line that equals `line`, wherever it stands (files that were joined repeat their header)."""
    lines = spark.read.text(path).where(F.col("value") != line)
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def word_file(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file, between white space; repeated words once."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''").distinct()


def points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, x) from headerless lines `id,x0,x1,...`."""
    names = [f"x{i}" for i in range(dims)]
    rows = spark.read.schema("id string, " + ", ".join(f"{n} double" for n in names)).csv(path, header=False)
    return rows.select("id", F.array(*names).alias("x"))


def chunk_paths(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder in order of their names, hidden ones left out; any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath()) for f in found if not f.getPath().getName().startswith((".", "_")))


def label_document(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a file that is one object {"id": label, ...}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, int>").alias("m"))
    return whole.select(F.explode("m").alias("id", "label"))


def last_by_key(rows: DataFrame, keys: list[str], value: str, order: list[Column | str]) -> DataFrame:
    """One row for each key, with the value of the row that is last in `order`."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
