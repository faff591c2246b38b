"""A corpus pipeline: documents of a recognised language, one of each group of near copies, none with benchmark passages, without personal data, packed into sequences.

Each stage takes nulls in any column, empty tables, repeated ids and extra columns of any name; what it makes of them is told where its operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, neardup, packing, pii
from millrace.llm.common import small_batches
from millrace.sources.scratch import dropped, temporary, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model of `docs` rejects, those without letters among them."""
    small_batches(spark)
    return langid.recognised(docs, langid.trained(docs.where(~langid.held_out("doc_id", 4, 2))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that shares 80 % or more of its 5-word shingles."""
    small_batches(spark)
    return neardup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words of a benchmark item, or a whole shorter one."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts n_chars anew."""
    small_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("sequences", sequences)]
#: SQL cannot state the language model and the field; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written; what a stage wrote on the way goes when its result is written, and that when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with temporary() as own:
            docs = written(stage(spark, docs, sf_dir))
            own.remove(docs)
        if before is not None:
            dropped(before)
        before = docs
    return docs
