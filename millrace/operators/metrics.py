"""Agreement of two labellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nmi(labels: DataFrame, true: str = "true", found: str = "found") -> DataFrame:
    """One row (nmi): mutual information over the mean of both entropies; 1 if both labellings are constant, null over no rows. Rows with a null label are left out."""
    cells = labels.where(F.col(true).isNotNull() & F.col(found).isNotNull()).groupBy(F.col(true).alias("t"), F.col(found).alias("p")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("t").agg(F.sum("n").alias("nt")), cells.groupBy("p").agg(F.sum("n").alias("np"))
    total = cells.agg(F.sum("n").cast("double").alias("all"))

    def entropy(counts: DataFrame, n: str, name: str) -> DataFrame:
        return counts.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(n) / F.col("all") * F.log(F.col(n) / F.col("all"))).alias(name))

    joint = cells.join(rows, "t").join(columns, "p").crossJoin(F.broadcast(total))
    shared = joint.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nt") * F.col("np")))).alias("mi"))
    both = shared.crossJoin(entropy(rows, "nt", "ht")).crossJoin(entropy(columns, "np", "hp"))
    return both.select(F.when(F.col("ht") + F.col("hp") > 0, 2 * F.col("mi") / (F.col("ht") + F.col("hp"))).when(F.col("mi").isNotNull(), 1.0).alias("nmi"))
