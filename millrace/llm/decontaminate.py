"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, which scans each text once.

Keys are not all windows of an item but its aligned pieces of half a window, one of which lies in each window: the words around a piece that occurs
are compared with the item's, which gives every window in that place at once. So the automaton has about one node for each letter of the items. Pieces
that stand in many places of items are no keys; windows that hold no other are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_filter, arrow_map, blob, named, plain_words, shared

WINDOW = 10
#: Places of items in which a piece may stand and be a key.
COMMON = 64
#: Bytes of item texts up to which the automaton, some 30 bytes for each, is sent to every task; more is an error. The benchmark may be given in parts.
MOST_BYTES = 16 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def letters(words: Sequence[bytes]) -> str:
    """Words with a space at each end, so that keys match whole ones."""
    return " " + b" ".join(words).decode("latin-1") + " "


class Matcher:
    """All windows of `width` consecutive words of items (id, text); an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int = WINDOW, common: int = COMMON):
        self.width, self.piece = width, (width + 1) // 2
        texts: dict[tuple[bytes, ...], set[str]] = {}
        same: dict[bytes, bytes] = {}
        for item, text in items:
            if found := tuple(same.setdefault(w, w) for w in plain_words(text)):
                texts.setdefault(found, set()).add(item)
        self.sequences, self.items = list(texts), [frozenset(x) for x in texts.values()]
        h = self.piece
        long_ = [(s, q) for s, q in enumerate(self.sequences) if len(q) >= width]
        times = Counter(q[i : i + h] for _, q in long_ for i in range(0, len(q) - h + 1, h))
        windows: dict[tuple[bytes, ...], set[int]] = {}
        places: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for s, q in enumerate(self.sequences):
            if len(q) < width:
                windows.setdefault(q, set()).add(s)
                continue
            rare = [times[q[i : i + h]] <= common for i in range(0, len(q) - h + 1, h)]
            for k, good in enumerate(rare):
                if good:
                    places.setdefault(q[k * h : k * h + h], []).append((s, k * h))
            for i in range(len(q) - width + 1):
                if not any(rare[-(-i // h) : (i + width) // h]):
                    windows.setdefault(q[i : i + width], set()).add(s)
        self.automaton = ahocorasick.Automaton()
        for key in windows.keys() | places.keys():
            self.automaton.add_word(letters(key), (len(key), tuple(windows.get(key, ())), tuple(places.get(key, ()))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of word numbers, first and end, that occurrences of windows cover, and the items."""
        ranges: list[tuple[int, int]] = []
        found: set[int] = set()
        if not len(self.automaton) or not words:
            return ranges, set()
        hits = list(self.automaton.iter(letters(words)))
        if not hits:
            return ranges, set()
        spaces = np.cumsum([len(w) + 1 for w in words])  # of the space after each word
        reached: dict[tuple[int, int], int] = {}  # by item and shift: where the last run of equal words ended
        for last, (_, (size, whole, places)) in zip(np.searchsorted(spaces, [end for end, _ in hits]).tolist(), hits, strict=True):
            first = last + 1 - size
            if whole:
                ranges.append((first, last + 1))
                found.update(whole)
            for s, at in places:
                shift = first - at
                if reached.get((s, shift), 0) > last:
                    continue
                q, low, high = self.sequences[s], at, at + size
                while low and shift + low and q[low - 1] == words[shift + low - 1]:
                    low -= 1
                stop = min(len(q), len(words) - shift)
                while high < stop and q[high] == words[shift + high]:
                    high += 1
                reached[s, shift] = shift + high
                if high - low >= self.width:
                    ranges.append((shift + low, shift + high))
                    found.add(s)
        return ranges, {i for s in found for i in self.items[s]}


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matcher(benchmark: DataFrame, item_col: str, text_col: str, width: int):
    """A function that gives the matcher of all items in any task. Null items and texts are left out."""
    rows = benchmark.select(F.col(named(item_col)).cast("string").alias("item"), blob(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"items of {size} bytes; give the benchmark in parts of up to {MOST_BYTES}")
    return shared(benchmark.sparkSession, Matcher([(r["item"], bytes(r["text"])) for r in rows.toLocalIterator()], width))


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of documents: id_col, the columns `keep`, n_words, n_hit, n_items, items_sha256, contaminated, items and spans.

    spans: byte ranges, first and end, of hit words in the original UTF-8 text. Null and empty texts have no words; null items are left out; items
    of fewer than `width` words are one window; repeated rows are scanned each. An empty benchmark hits nothing; an empty table gives an empty result.
    """
    given = matcher(benchmark, item_col, item_text, width)
    names = [id_col, *keep]

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = batch["__text"]
        hits, items, counts = [], [], []
        for text in texts:
            words = plain_words(text)
            ranges, found = given().scan(words)
            counts.append(len(words))
            hits.append(ranges)
            items.append(found)
        out: dict[str, list] = {k: batch[k] for k in names} | {"n_words": counts} | {k: [] for k in ("n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")}
        none = hashlib.sha256(b"").hexdigest()
        for text, ranges, found in zip(texts, hits, items, strict=True):
            spans, ids = [], sorted(found)
            ranges = union(ranges)
            if ranges:
                at = [m.span() for m in WORD.finditer(text)]
                spans = [{"first": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
            n = sum(b - a for a, b in ranges)
            for k, v in (("n_hit", n), ("n_items", len(ids)), ("items_sha256", hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else none), ("contaminated", n > 0), ("items", ids), ("spans", spans)):
                out[k].append(v)
        return out

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{named(k)} {kinds[k]}" for k in names) + ", n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first: bigint, end: bigint>>"
    return arrow_map(documents.select(*(F.col(named(n)) for n in names), blob(text_col).alias("__text")), schema, run)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, i, k, item FROM pos JOIN win USING (k, s)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit), unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """documents without those in which a window of an item occurs. Null texts and repeated rows stay, and so do all columns; an empty table stays empty."""
    given = matcher(benchmark, item_col, item_text, width)
    return arrow_filter(documents, text_col, lambda texts: [not given().scan(plain_words(t.encode()) if t else [])[0] for t in texts])
