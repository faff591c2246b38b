"""Best-two-fit packing of token pieces into sequences.

Which lengths share a sequence depends only on how many pieces there are of each length, so the driver packs that histogram (no more than `room`
rows, however large the corpus), making patterns with multiplicities. Each piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, named, written

ROOM = 2048
#: Pieces of one length are ranked in this many groups or more, so that a common length is no single task's.
GROUPS = 256
#: Characters of white space in a row, from which on the named tokenizer is used.
LONG_SPACE = 20_000
_SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


def pieces(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    head = n % room or room
    return [(0, head)] + [(s, room) for s in range(head, n, room)]


def best_two_fit(histogram: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, lengths) patterns that use each length as often as the histogram has it.

    A sequence takes the longest piece, then ever the longest that fits. If a gap stays, its smallest piece is replaced by the two unpacked pieces
    that fill the widened gap best, if they fill more of it. A pattern is repeated as often as the counts allow.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(left)
    out = []

    def take(k: int) -> None:
        left[k] -= 1
        if not left[k]:
            del left[k]
            order.pop(bisect_left(order, k))

    def give(k: int) -> None:
        if k not in left:
            left[k] = 0
            insort(order, k)
        left[k] += 1

    while order:
        chosen, gap = [], room
        while order and (i := bisect_right(order, gap)):
            k = order[i - 1]
            # As many of one length as fit, at once.
            for _ in range(min(left[k], gap // k)):
                chosen.append(k)
                gap -= k
                take(k)
        if gap and len(chosen) > 1 and order:
            small = chosen[-1]
            wide, best = gap + small, (small, 0, 0)
            low, high = 0, bisect_right(order, wide) - 1
            while low <= high:
                a, b = order[low], order[high]
                if a + b > wide or (low == high and left[a] < 2):
                    high -= 1
                    continue
                if a + b > best[0]:
                    best = (a + b, a, b)
                low += 1
            if best[1]:
                chosen.pop()
                give(small)
                for k in best[1:]:
                    chosen.append(k)
                    take(k)
        need: dict[int, int] = {}
        for k in chosen:
            need[k] = need.get(k, 0) + 1
        times = 1 + min(left.get(k, 0) // n for k, n in need.items())
        for k, n in need.items():
            if times > 1:
                left[k] -= n * (times - 1)
                if not left[k]:
                    del left[k]
                    order.pop(bisect_left(order, k))
        out.append((times, tuple(chosen)))
    return out


def placements(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: the pieces from that rank to the next row's lie in successive sequences."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for k in lengths:
            rows.append((k, rank.get(k, 0), sequence, offset))
            rank[k] = rank.get(k, 0) + times
            offset += k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that a tokenizer's JSON adds to its vocabulary, which are found in any text before it is split."""
    with open(path, "rb") as f:
        found = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that match otherwise than by their characters: {odd}")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """Ids of texts by the tokenizer in a JSON file, without special tokens around them.

    The ranks file of the same vocabulary beside it, if there is one, gives the same ids several times faster. Its pattern looks ahead after white
    space, one level of the C stack for each character, so texts with long stretches of that go to the named tokenizer itself.
    """

    def __init__(self, path: str):
        base = path.removesuffix(".json").removesuffix(".tiktoken")
        self.path, self.named, self.fast = f"{base}.json", None, None
        ranks = f"{base}.tiktoken"
        if os.path.exists(ranks):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=table, special_tokens=added_tokens(self.path))

    def ids(self, text: str) -> list[int]:
        if self.fast and (len(text) < LONG_SPACE or not _SPACES.search(text)):
            return self.fast.encode(text, allowed_special="all")
        if self.named is None:
            from tokenizers import Tokenizer

            self.named = Tokenizer.from_file(self.path)
        return self.named.encode(text, add_special_tokens=False).ids


def tokenizer_path() -> str:
    """Where this machine, the driver's or an executor's, has the tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(documents: DataFrame, path: str | None, id_col: str, text_col: str, room: int, end: int) -> DataFrame:
    """A row for each piece of each document. path: the tokenizer's JSON (or its ranks file) on every machine; None: where the installed package of each machine has it."""
    kind = dict(documents.dtypes)[id_col]
    made: list[Encoder] = []

    def run(batch: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Encoder(path or tokenizer_path()))
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
        for id_, text in zip(batch["id"], batch["text"], strict=True):
            ids = np.array([*made[0].ids(text or ""), end], "<u4")
            for p, (s, n) in enumerate(pieces(len(ids), room)):
                for k, v in (("id", id_), ("piece", p), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(ids[s : s + n]))):
                    out[k].append(v)
        return out

    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", run)


def packed(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece; null text is empty, and each document ends with the id `end`.

    Repeated rows are packed each; ties of length are ranked in any order that the tables keep; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    table = written(tokenized(documents, path, id_col, text_col, room, end))
    rows = table.count()
    groups = max(GROUPS, rows // 200_000)
    grouped = table.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))
    counts = written(grouped.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(placements(best_two_fit(histogram, room)))
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = grouped.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1).join(before, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("bigint").alias("rank"))

    def place(batch: dict[str, list]) -> dict[str, list]:
        rows, big = places.value, np.int64(1 << 48)
        length, rank = np.array(batch["length"], np.int64), np.array(batch["rank"], np.int64)
        at = np.searchsorted(rows[:, 0] * big + rows[:, 1], length * big + rank, "right") - 1
        batch["sequence_id"] = (rows[at, 2] + rank - rows[at, 1]).tolist()
        batch["offset"] = rows[at, 3].tolist()
        return batch

    kind = dict(documents.dtypes)[id_col]
    return arrow_map(ranked, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", place).withColumnRenamed("id", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
