"""Scratch tables in the folder that the cluster shares.

Tables go at the latest when the driver's JVM ends. Those of a job whose result is written go at once if the job ran within temporary().
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows up to this number may be broadcast as a lookup table; beyond it a shuffle join takes over.
BROADCAST_ROWS = 1_000_000
#: The tables of each open temporary(), the innermost last.
_open: list[list[DataFrame]] = []
#: Folders of applications, by their id and the shared folder.
_roots: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local one is set only where it is unset and the driver's machine is the only one, as in tests."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A path, where nothing is yet, in this application's folder."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _roots:
        _roots[key] = f"{key[1]}/millrace-{uuid.uuid4().hex}"
        at, files = _folder(spark, _roots[key])
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{_roots[key]}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and lost executors cannot take it with them."""
    path = new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _open:
        _open[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written()."""
    for df in tables:
        at, files = _folder(df.sparkSession, df.scratch)
        files.delete(at, True)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished stages, which it does when the driver collects its garbage. For operators of many stages, between them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that were written within, but those taken out of the list that it gives."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        dropped(*_open.pop())


def fits(table: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many rows (counted from its footers)."""
    return table.count() <= most
