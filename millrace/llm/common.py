"""What the operators of this folder share: words, hashes, functions over Arrow batches, bounded broadcasts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from millrace.sources.scratch import dropped, swept, written  # noqa: F401

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Ids up to this number (8 bytes each) may be broadcast; beyond it a shuffle join takes over.
BROADCAST_IDS = 1_000_000


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of digits, lower-cased letters and non-ASCII characters; None has none."""
    return text.translate(PLAIN).split() if text else []


def blob(column: str = "text"):
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(named(column)).cast("binary").alias(column)


def parts(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about `most` bytes of texts and lists, or one longer row, so that what a task holds does not grow with the batch."""
    for batch in batches:
        size = np.full(batch.num_rows, 16, np.int64)
        for c in batch.columns:
            if pa.types.is_list(c.type):
                size += 8 * pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
            elif pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def small_batches(spark: SparkSession) -> None:
    """For a session of its own, such as that of a query or a pipeline: sends 1,000 rows at once to Python where it has Spark's 10,000, as executors hold batches of whole texts outside their heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def named(column: str) -> str:
    """A column's name as SQL writes it, whatever characters it has."""
    return f"`{column.replace('`', '``')}`"


def in_arrow(df: DataFrame, schema: StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow, where columns on the way go by their places, as it takes no names with dots or backticks."""
    places = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, places).toDF(*schema.names)


def arrow_map(df: DataFrame, schema: str | StructType, function: Callable[[dict], dict | Iterator[dict]], raw: tuple[str, ...] = ()) -> DataFrame:
    """A DataFrame of this schema, for a function from a batch's columns, as lists (those of `raw` as Arrow arrays), to the output's columns, at once or in parts."""
    schema, names = StructType.fromDDL(schema) if isinstance(schema, str) else schema, df.columns
    arrow = to_arrow_schema(StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = function({n: batch.column(i) if n in raw else batch.column(i).to_pylist() for i, n in enumerate(names)})
            for part in (out,) if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := part[n], pa.Array) else pa.array(v, f.type) for n, f in zip(schema.names, arrow, strict=True)], schema=arrow)

    return in_arrow(df, schema, run)


def arrow_filter(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of df, with all its columns, for which keep() says so of the values of one column."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return in_arrow(df, df.schema, run)


def shared(spark: SparkSession, value) -> Callable:
    """A function that gives `value` in any task. Classes travel by value too, so executors need no copy of this package."""
    data, made = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not made:
            made.append(pickle.loads(data.value))
        return made[0]

    return get


def few_ids(ids: DataFrame, key: str, most: int) -> bool:
    """Whether a written table has up to `most` keys, which are up to 8 * `most` bytes in all."""
    if dict(ids.dtypes)[key] not in ("string", "binary"):
        return ids.limit(most + 1).count() <= most
    row = ids.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(named(key))).alias("size")).first()
    return row["n"] <= most and (row["size"] or 0) <= 8 * most


def restricted(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in ids (distinct, in a written table). The ids are counted; up to `most` are broadcast, more are joined by a shuffle."""
    few = few_ids(ids, key, most)
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def excluded(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is not in ids; otherwise as restricted()."""
    few = few_ids(ids, key, most)
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, of all texts in turn, and offsets: text i has words offsets[i] to offsets[i + 1]."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up)])
    hashes = mix64((total[end] - total[begin]) * down[begin])
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begin, at)


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, or a single longer text."""
    low = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield low, i
            low, size = i, 0
        size += len(t) + 1
    if size:
        yield low, len(texts)
