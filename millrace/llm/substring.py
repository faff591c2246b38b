"""Removal of long passages that repeat across documents, found by recompression.

Each round names maximal runs of one symbol, then pairs of a symbol of the left class with one of the right class; the class is a hash bit of the
symbol. A name is a 64-bit hash of what it stands for, so all tasks of a Spark job name alike without a shared dictionary. Every symbol carries its
context: the words on which its forming depended. A window whose words contain a symbol's context therefore has that symbol wherever it occurs.
The anchor of a window is its least symbol of the highest level that has one; words themselves are level 0, so every window has an anchor and equal
windows have equal anchors, at equal places. Spark keeps anchors that occur in two documents. Up to STEP windows that lie alike to one anchor are a
run; the words that all windows of such a place have are its core, and only runs whose core occurs in two documents stay. Of those, runs of equal
words are settled as a whole, and only of the first document that has them are the windows compared one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, blob, chunks, dropped, excluded, mix64, named, powers, restricted, swept, word_hashes, written

LEVELS = 6
#: Windows of a run.
STEP = 8
#: Pairs of a symbol and a window that are looked at together.
EXPANDED = 1 << 21
#: Bytes of a text that are read at once; longer texts go in pieces that overlap by all words of a window but one, which have the same windows and anchors.
LONG = 1 << 21
_EDGE = re.compile(rb"[\x20\x09-\x0d]")


def _near(values: np.ndarray, inside: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """values of the neighbour before (step 1) or after (step -1); edge where there is none in the document."""
    return np.where(inside, np.roll(values, step), edge)


def parse(words: np.ndarray, at: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 0: symbols, and the first and the end word of their contexts (beyond the document where its edge mattered)."""
    n = len(words)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left, right = np.arange(n), np.arange(1, n + 1)
    before, after = at[:-1] - 1, at[1:] + 1
    out, sym = [(words, left, right)], words
    for level in range(1, levels + 1):
        if not len(sym):
            break
        # Runs.
        same = np.concatenate([[False], doc[1:] == doc[:-1]])
        head = np.flatnonzero(~(same & (sym == np.roll(sym, 1))))
        tail = np.concatenate([head[1:], [len(sym)]]) - 1
        k = (tail - head + 1).astype(np.uint64)
        has_next = np.concatenate([same[1:], [False]])
        low = _near(left, same, before[doc], 1)[head]
        high = _near(right, has_next, after[doc], -1)[tail]
        sym = np.where(k > 1, mix64(sym[head] * np.uint64(0x9FB21C651E98DF25) + k), sym[head])
        left, right, doc = np.minimum(left[head], low), np.maximum(right[tail], high), doc[head]
        # Pairs.
        second = (mix64(sym + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        same = np.concatenate([[False], doc[1:] == doc[:-1]])
        has_next = np.concatenate([same[1:], [False]])
        opens = ~second & has_next & np.roll(second, -1)
        closes = np.concatenate([[False], opens[:-1]])
        following = np.roll(sym, -1)
        low = np.where(opens | ~second, left, _near(left, same, before[doc], 1))
        high = np.where(opens, np.roll(right, -1), np.where(second, right, _near(right, has_next, after[doc], -1)))
        sym = np.where(opens, mix64(sym * np.uint64(0xD1342543DE82EF95) + mix64(following + np.uint64(level))), sym)
        stay = ~closes
        sym, left, right, doc = sym[stay], np.minimum(left, low)[stay], np.maximum(right, high)[stay], doc[stay]
        out.append((sym, left, right))
    return out


def anchors(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every window of `width` words, the window's document, its first word and that of the anchor's first occurrence in it (counted over all documents)."""
    n, sizes = len(words), np.diff(at)
    windows = np.maximum(sizes - width + 1, 0)
    valid = np.zeros(n + 1, bool)
    first = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(at[:-1], windows)
    valid[first] = True
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best, place = np.full(n, none), np.zeros(n, np.int64)
    for symbols, left, right in reversed(parse(words, at)):
        open_ = valid[:n] & (best == none)
        todo = np.concatenate([[0], np.cumsum(open_)])
        if not todo[-1]:
            break
        low, high = np.maximum(right - width, 0), np.minimum(left, n - 1)
        fits = np.flatnonzero((right - left <= width) & (low <= high))
        fits = fits[todo[high[fits] + 1] > todo[low[fits]]]
        low, count = low[fits], (high - low)[fits] + 1
        hashed = mix64(symbols[fits] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1)
        # A symbol lies in up to `width` windows; so many are spread out at once as take bounded memory.
        turn = (np.cumsum(count) - count) // EXPANDED
        edges = [*changes(turn).tolist(), len(turn)]
        for a, b in pairwise(edges):
            starts = np.repeat(low[a:b] - np.cumsum(count[a:b]) + count[a:b], count[a:b]) + np.arange(count[a:b].sum())
            wanted = open_[starts]
            starts, value = starts[wanted], np.repeat(hashed[a:b], count[a:b])[wanted]
            before = best[starts]
            np.minimum.at(best, starts, value)
            least = np.flatnonzero((best[starts] == value) & (before > value))[::-1]  # the first occurrence is assigned last
            place[starts[least]] = np.repeat(left[fits[a:b]], count[a:b])[wanted][least]
    return best[first], np.repeat(np.arange(len(sizes)), windows), first, place[first]


def range_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the words from first to before end."""
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words ^ np.uint64(seed)) * up[:-1])])
    return mix64((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)).view(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the place before; the first place too."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def slices(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """The text in parts of about `most` bytes that end between words."""
    most, low = most or LONG, 0
    while low < len(text):
        edge = _EDGE.search(text, low + most)
        high = edge.start() if edge else len(text)
        yield text[low:high]
        low = high


def read(text: bytes | None) -> tuple[int, bytes, int]:
    """Number of words, SHA-256 of the words joined by one space, and a number that tells the texts of one id apart."""
    n, sha, number = 0, hashlib.sha256(), xxhash.xxh3_64()
    for part in slices(text or b""):
        if words := part.split():
            joined = (b" " if n else b"") + b" ".join(words)
            sha.update(joined)
            number.update(joined)
            n += len(words)
    return n, sha.digest(), number.intdigest() - (1 << 63)


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes of words, offsets of documents, number of the first document, its words before) for groups of short texts, and for each piece of a long one."""
    for low, high in chunks(texts):
        if high - low > 1 or len(texts[low]) <= LONG:
            yield *word_hashes(texts[low:high]), low, 0
            continue
        rest, before = np.zeros(0, np.uint64), 0
        for part in slices(texts[low]):
            words = np.concatenate([rest, word_hashes([part])[0]])
            yield words, np.array([0, len(words)]), low, before
            keep = min(width - 1, len(words))
            rest, before = words[len(words) - keep :], before + len(words) - keep


def repeated_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) for every row: words under windows of `width` words that also start in a document of a smaller id go.

    Null, empty and short texts lose nothing. A null id is never compared. Repeated rows of one id are no smaller than each other, so they lose only
    what other ids have. An empty table gives an empty result; other columns are ignored.
    """
    kind, step = dict(documents.dtypes)[id_col], min(STEP, width)
    source = documents.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text"))

    def count(batch: dict) -> dict:
        found = [read(text) for text in batch["text"]]
        return {"id": batch["id"], "n": [n for n, _, _ in found], "sha": [x for _, x, _ in found], "copy": [x for _, _, x in found]}

    base = written(arrow_map(source, f"id {kind}, n bigint, sha binary, copy bigint", count))
    long_ = base.where((F.col("n") >= width) & F.col("id").isNotNull())
    first = written(long_.groupBy("sha").agg(F.min("id").alias("head")))
    # An exact copy of an earlier document loses all its words and need not be looked at again.
    marked = base.where("id IS NOT NULL").join(first, "sha", "left").select("id", F.coalesce(F.col("id") > F.col("head"), F.lit(False)).alias("again"))
    copies = written(marked.groupBy("id").agg(F.min("again").alias("again")).where("again").select("id"))
    rest = excluded(source.where("id IS NOT NULL"), copies, "id")

    def find(batch: dict) -> Iterator[dict]:
        for words, at, low, _ in pieces([x or b"" for x in batch["text"]], width):
            anchor, doc, _, _ = anchors(words, at, width)
            order = np.lexsort((anchor, doc))
            new = order[changes(anchor[order], doc[order])]
            yield {"id": batch["id"].take(pa.array(doc[new] + low)), "anchor": pa.array(anchor[new].view(np.int64))}

    heard = written(arrow_map(rest, f"id {kind}, anchor bigint", find, raw=("id",)))
    several = written(heard.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"))
    # A document's own anchors, no more than its words.
    shared = written(restricted(heard, several, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")))
    dropped(heard, several)
    swept(documents.sparkSession)
    near = restricted(rest, written(shared.select("id")), "id").join(shared, "id")

    def compare(batch: dict) -> Iterator[dict]:
        texts, known = [x or b"" for x in batch["text"]], batch["anchors"]
        ends = known.offsets.to_numpy()
        values, last, number = known.values.to_numpy(zero_copy_only=False), -1, 0
        for words, at, low, before in pieces(texts, width):
            anchor, doc, first, place = anchors(words, at, width)
            line = (place - first) // step
            begin = changes(doc, anchor, place, line)
            end = np.append(begin[1:], len(anchor))
            bounds = np.searchsorted(doc[begin], np.arange(len(at)))
            held = np.concatenate([np.isin(anchor[begin[a:b]].view(np.int64), values[ends[low + d] : ends[low + d + 1]]) for d, (a, b) in enumerate(pairwise(bounds))])
            begin, end = begin[held], end[held]
            if not len(begin):
                continue
            which, core = doc[begin], place[begin] - step * line[begin]
            copies = {}
            for d in set(which.tolist()):
                if low + d != last:
                    last, number = low + d, read(texts[low + d])[2]
                copies[d] = number
            size = end - begin
            inside = first[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
            yield {
                "id": batch["id"].take(pa.array(which + low)),
                "copy": [copies[d] for d in which.tolist()],
                "core": pa.array(mix64(range_hashes(words, core, core + width - step + 1, 0xA24BAED4963EE407).view(np.uint64) + anchor[begin] * np.uint64(64) + line[begin].astype(np.uint64)).view(np.int64)),
                "run": pa.array(range_hashes(words, first[begin], first[end - 1] + width, 0xE7037ED1A0B428DB)),
                "at": pa.array(first[begin] - at[which] + before),
                "hashes": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(range_hashes(words, inside, inside + width, 0x8CB92BA72F3D8DD7))),
            }

    found = written(arrow_map(near, f"id {kind}, copy bigint, core bigint, run bigint, at bigint, hashes array<bigint>", compare, raw=("id", "anchors")))
    dropped(shared)
    # Each side of the joins below is a written table, so that Spark can split the partitions of frequent keys.
    across = written(found.groupBy("core").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("core"))
    alike = written(restricted(found, across, "core"))
    dropped(found, across)
    swept(documents.sparkSession)
    # Of equal runs, all but those of the smallest id go as a whole; what matches a window of one of them matches the smallest one's.
    heads = written(alike.groupBy("core", "run").agg(F.min("id").alias("head")))
    settled = alike.select("id", "copy", "core", "run", "at", F.size("hashes").alias("n")).join(heads, ["core", "run"]).where("head < id").select("id", "copy", "at", "n")
    several = written(heads.groupBy("core").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("core"))
    firsts = written(restricted(heads, several, "core").select("core", "run", F.col("head").alias("id")))
    windows = alike.join(firsts, ["core", "run", "id"]).select("id", "copy", "core", "at", F.posexplode("hashes").alias("place", "hash"))
    windows = written(windows.select("id", "copy", "core", "hash", (F.col("at") + F.col("place")).alias("at")))
    least = written(windows.groupBy("core", "hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("core", "hash", "least"))
    single = windows.join(least, ["core", "hash"]).where("least < id").select("id", "copy", "at", F.lit(1).alias("n"))
    # Ranges of a document's own windows, no more than its words.
    covered = written(settled.unionByName(single).groupBy("id", "copy").agg(F.collect_list(F.struct("at", "n")).alias("ranges")))
    dropped(alike, heads, several, firsts, windows, least)
    swept(documents.sparkSession)
    hit = restricted(source, written(covered.select("id").distinct()), "id")

    def cut(batch: dict) -> dict:
        out: dict[str, list] = {"id": [], "copy": [], "n_removed": [], "kept": []}
        for i, (id_, text, copy) in enumerate(zip(batch["id"], batch["text"], batch["copy"], strict=True)):
            n, _, number = read(text)
            if number != copy:
                continue  # another row of the same id
            ranges = batch["ranges"][i].values
            edge = np.zeros(n + 1, np.int32)
            starts = ranges.field("at").to_numpy()
            np.add.at(edge, starts, 1)
            np.subtract.at(edge, starts + ranges.field("n").to_numpy() + (width - 1), 1)
            gone, sha, before, kept = np.cumsum(edge)[:-1] > 0, hashlib.sha256(), 0, False
            for part in slices(text):
                words = part.split()
                stay = [w for w, g in zip(words, gone[before : before + len(words)].tolist(), strict=True) if not g]
                if stay:
                    sha.update((b" " if kept else b"") + b" ".join(stay))
                    kept = True
                before += len(words)
            out["id"].append(id_)
            out["copy"].append(copy)
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(sha.digest())
        return out

    cuts = arrow_map(hit.join(covered, "id"), f"id {kind}, copy bigint, n_removed bigint, kept binary", cut, raw=("ranges",)).dropDuplicates(["id", "copy"])
    whole = base.join(first, "sha", "left").withColumn("again", F.coalesce(F.col("id") > F.col("head"), F.lit(False)))
    out = whole.join(cuts, ["id", "copy"], "left").select(
        "id", "n", F.when(F.col("again"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"), F.when(F.col("again"), F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept")
    )
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "n_removed", F.col("kept").alias("kept_sha256"))


def op9_recompression(spark, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, j FROM win JOIN least USING (h), unnest(range(i, i + 50)) AS t(j) WHERE m < doc_id),
told AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS words FROM told ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
