"""Toxicity: nearest labelled examples by exact TF-IDF cosine from a block-max inverted index; distance-weighted votes, calibrated.

Terms are all words and word beginnings of the examples whose rates under the two labels differ by more than chance explains (a likelihood-ratio test
that allows for the number of terms tested). A component is the term's share of the text's words, times idf, times how far the term tells the labels
apart; terms on the verge of the test weigh next to nothing. One more component of constant weight stands for all other words, so the cosine falls
with the share of telling words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_IDS, arrow_map, blob, dropped, few_ids, named, shared, written
from millrace.llm.langid import held_out

#: Expected numbers of labelled examples that the fit takes, of label 1 and 0.
POSITIVE, NEGATIVE = 2000, 3000
NEIGHBOURS, BLOCK = 15, 32
#: Chance that any term without a bearing on the labels passes the test.
CHANCE = 0.05
PREFIXES = (3, 4, 5, 6, 7)
RESTS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Examples on which the weight of other words is tried, each left out in turn.
TRIED = 400
#: ASCII other than letters and digits parts words; letters were lower-cased before.
_PARTS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_PARTS).split() if text else []


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, which a star marks."""
    if word.isascii():
        return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]
    s = word.decode()
    return [word, *(s[:k].encode() + b"*" for k in PREFIXES if len(s) > k)]


class Terms(dict):
    """word -> numbers of its terms, found when first asked for; forgets all when it has grown large."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = tuple(n for t in terms_of(word) if (n := self.numbers.get(t)) is not None)
        return out


def counted(text: bytes | None, terms: Terms) -> tuple[tuple[tuple[int, int], ...], int]:
    """(term, times) in order of terms, and the number of words."""
    w = words(text)
    return tuple(sorted(Counter(n for found in map(terms.__getitem__, w) if found for n in found).items())), len(w)


def weights(counts: tuple[tuple[int, int], ...], n: int, worth: np.ndarray) -> tuple[tuple[int, float], ...]:
    """(term, share of the words in percent times what the term is worth)."""
    return tuple((t, 100 * c / n * float(worth[t])) for t, c in counts)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at `first` and have `count` members, in turn."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """Postings of unit vectors by term. Those of one term and one block of examples are a segment, which knows its largest weight."""

    def __init__(self, rows: list[list[tuple[int, float]]], n_terms: int):
        self.n = len(rows)
        self.blocks = (self.n + BLOCK - 1) // BLOCK
        size = [len(r) for r in rows]
        example = np.repeat(np.arange(self.n), size)
        term = np.array([t for r in rows for t, _ in r], np.int64)
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], np.array([w for r in rows for _, w in r])[order]
        key = term * max(1, self.blocks) + self.example // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.begin = np.append(begin, len(key))  # of each segment's postings
        self.block = self.example[begin] // BLOCK
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.segments = np.searchsorted(term[begin], np.arange(n_terms + 1))

    def nearest(self, query: list[tuple[int, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest dot product with a unit query (of ties, the first), and the products.

        No example of a block can have more than the sum of its segments' largest weights times those of the query. Blocks go by falling bound, a
        few at a time, until none that is left can enter.
        """
        t, q = np.array([a for a, _ in query], np.int64), np.array([b for _, b in query])
        count = self.segments[t + 1] - self.segments[t]
        segment, factor = spread(self.segments[t], count), np.repeat(q, count)
        block = self.block[segment]
        bound = np.bincount(block, factor * self.most[segment], self.blocks)
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(self.blocks, np.int64)
        rank[order] = np.arange(self.blocks)
        turn = rank[block]
        ids, dots, low, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while low < self.blocks and (len(ids) < k or bound[order[low]] >= dots[-1] - 1e-12):
            now = (turn >= low) & (turn < low + step)
            size = self.begin[segment[now] + 1] - self.begin[segment[now]]
            at = spread(self.begin[segment[now]], size)
            sums = np.bincount(self.example[at], np.repeat(factor[now], size) * self.weight[at], self.n)
            some = (order[low : low + step, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
            some = some[some < self.n]
            ids, dots = np.concatenate([ids, some]), np.concatenate([dots, sums[some]])
            top = np.lexsort((ids, -dots.round(12)))[:k]
            ids, dots = ids[top], dots[top]
            low, step = low + step, 2 * step
        return ids, dots


def unit(row: tuple[tuple[int, float], ...], rest: int, weight: float) -> list[tuple[int, float]]:
    norm = np.sqrt(weight**2 + sum(w * w for _, w in row))
    return [(t, w / norm) for t, w in row] + [(rest, weight / norm)]


def logit(p: float | np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibration(raw: np.ndarray, votes: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from raw scores to the share of label 1, with a weak pull to (1, 0); votes: weights of labels 0 and 1. Newton's method with halved steps."""
    x = np.stack([logit(raw), np.ones(len(raw))], 1)
    votes = votes * (len(raw) / max(votes.sum(), 1e-9))

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((votes[:, 1] * np.logaddexp(0, -z) + votes[:, 0] * np.logaddexp(0, z)).sum() + ((at - [1, 0]) ** 2).sum() / 2)

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (votes.sum(1) * p - votes[:, 1]) + at - [1, 0]
        curve = (x * (votes.sum(1) * p * (1 - p))[:, None]).T @ x + np.eye(2)
        move = np.linalg.solve(curve, slope)
        while np.abs(move).max() > 1e-9 and loss(at - move) > loss(at):
            move /= 2
        at = at - move
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


class Model:
    """Fitted from examples (id, label, weight, counts of terms, number of words) and what each term is worth. score(): probability of label 1 and the nearest examples."""

    def __init__(self, rows: list[tuple], worth: dict[bytes, float]):
        self.numbers = {t: i for i, t in enumerate(sorted(worth))}
        self.worth = np.array([worth[t] for t in sorted(worth)])
        self.rest = len(self.numbers)
        groups: dict[tuple, list] = {}
        for key, y, w, counts, n in rows:
            g = groups.setdefault(weights(counts, n, self.worth), [0.0, 0.0, key])
            g[y] += w
            g[2] = min(g[2], key)
        order = sorted(groups, key=lambda r: (max(r, key=lambda p: p[1], default=(-1, 0))[0], r))  # like examples share a block
        self.votes = np.array([groups[r][:2] for r in order]).reshape(-1, 2)
        self.examples = [groups[r][2] for r in order]
        self.prior = self.votes[:, 1].sum() / max(self.votes.sum(), 1e-9) if len(order) else 0.0
        self.curve, best = (1.0, 0.0), None
        for weight in RESTS:
            self.weight, self.index = weight, Index([unit(r, self.rest, weight) for r in order], self.rest + 1)
            loss = 0.0
            for i in range(0, len(order), max(1, len(order) // TRIED)):
                p = min(max(self.raw(order[i], without=i)[0], 1e-3), 1 - 1e-3)
                loss -= self.votes[i, 1] * np.log(p) + self.votes[i, 0] * np.log(1 - p)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, weight, self.index)
        if best:
            self.weight, self.index = best[1:]
            self.curve = calibration(np.array([self.raw(r, without=i)[0] for i, r in enumerate(order)]).reshape(-1), self.votes) if order else self.curve
        self.none: tuple | None = None

    def raw(self, row: tuple, without: int = -1) -> tuple[float, list]:
        """Share of the votes, by distance, and the three nearest examples; `without`: a group of equal examples that has no vote."""
        ids, dots = self.index.nearest(unit(row, self.rest, self.weight), NEIGHBOURS + 1)
        stay = ids != without
        ids, dots = ids[stay][:NEIGHBOURS], dots[stay][:NEIGHBOURS]
        votes = self.votes[ids] * (1 / (0.01 + 1 - np.minimum(dots, 1)) ** 2)[:, None]
        return float((votes[:, 1].sum() + self.prior) / (votes.sum() + 1.0)), [(self.examples[i], float(d)) for i, d in zip(ids[:3].tolist(), dots[:3], strict=True)]

    def score(self, text: bytes | None, terms: Terms) -> tuple[float, list[tuple]]:
        if not len(self.votes):
            return 0.0, []
        row = weights(*counted(text, terms), self.worth)
        if not row and self.none:
            return self.none
        p, evidence = self.raw(row)
        out = float(1 / (1 + np.exp(-np.clip(self.curve[0] * logit(p) + self.curve[1], -500, 500)))), evidence
        if not row:
            self.none = out
        return out


def telling(rows: DataFrame, counts: dict[int, int]) -> dict[bytes, float]:
    """What each term that passes the test is worth, by term; rows: (label, text), counts: rows by label. Counted in Spark: the driver gets only what passes."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        seen = [Counter(), Counter()]
        for y, text in zip(batch["label"], batch["text"], strict=True):
            seen[y].update({t for w in set(words(text)) for t in terms_of(w)})
        terms = list(seen[0].keys() | seen[1].keys())
        return {"term": terms, "n0": [seen[0][t] for t in terms], "n1": [seen[1][t] for t in terms]}

    found = written(arrow_map(rows.select("label", "text"), "term binary, n0 bigint, n1 bigint", count).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    tested = found.count()
    if not (n0 and n1 and tested):
        return {}

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    both = F.col("n0") + F.col("n1")
    ratio = sum(part(F.lit(n) - F.col(c) if rest else F.col(c), ((n0 + n1 - both) if rest else both) * (n / (n0 + n1))) for n, c in ((n0, "n0"), (n1, "n1")) for rest in (False, True))
    limit = 2 * np.log(tested / CHANCE)  # the tail of chi-square with one degree of freedom falls faster than exp(-x / 2)
    apart = F.abs(F.log((F.col("n1") + 0.5) / (F.lit(n1) - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (F.lit(n0) - F.col("n0") + 0.5)))
    idf = F.log(1 + F.lit(float(n0 + n1)) / both)
    passed = found.withColumn("ratio", ratio).where(F.col("ratio") > float(limit)).select("term", (idf * apart * (1 - float(limit) / F.col("ratio"))).alias("worth"))
    out = {bytes(r["term"]): r["worth"] for r in passed.toLocalIterator()}
    dropped(found)
    return out


def trained(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """The model of about so many labelled ids of each label, chosen by a hash of the id; each counts for as many as it stands for.

    An id with both labels has label 1; labels other than 0 and 1, and null ids, are left out. Texts stay on executors: the driver gets the counts of
    telling terms of each example.
    """
    told = labels.where(F.col(named(label_col)).isin(0, 1) & F.col(named(id_col)).isNotNull()).groupBy(F.col(named(id_col)).alias("key")).agg(F.max(F.col(named(label_col)).cast("int")).alias("label"))
    told = written(told)
    n = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, m / max(1, n.get(k, 0))) for k, m in ((1, positive), (0, negative))}
    chosen = written(told.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= F.when(F.col("label") == 1, share[1] * 2**30).otherwise(share[0] * 2**30)))
    texts = documents.select(F.col(named(id_col)).alias("key"), blob(text_col).alias("text"))
    rows = written(texts.join(F.broadcast(chosen) if few_ids(chosen, "key", BROADCAST_IDS) else chosen, "key"))
    worth = telling(rows, {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()})
    given = shared(documents.sparkSession, {t: i for i, t in enumerate(sorted(worth))})

    def vector(batch: dict[str, list]) -> dict[str, list]:
        terms = Terms(given())
        found = [counted(t, terms) for t in batch["text"]]
        return {"key": batch["key"], "label": batch["label"], "n": [n for _, n in found], "term": [[t for t, _ in c] for c, _ in found], "times": [[k for _, k in c] for c, _ in found]}

    vectors = arrow_map(rows.select("key", "label", "text"), f"key {dict(rows.dtypes)['key']}, label int, n bigint, term array<int>, times array<bigint>", vector)
    out = Model([(r["key"], r["label"], 1 / share[r["label"]], tuple(zip(r["term"], r["times"], strict=True)), r["n"]) for r in vectors.toLocalIterator()], worth)
    dropped(told, chosen, rows)
    return out


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted and evidence (the ids of up to three nearest examples, the least id of equal ones, and their cosines) for every row.

    Null and empty texts score as texts without telling words; a model without examples scores 0; repeated rows give a row each; an empty table gives
    an empty result; other columns are ignored.
    """
    given = shared(documents.sparkSession, model)
    made: list[Terms] = []  # one for each task
    kind = dict(documents.dtypes)[id_col]

    def run(batch: dict[str, list]) -> dict[str, list]:
        one = given()
        if not made:
            made.append(Terms(one.numbers))
        rows = [one.score(t, made[0]) for t in batch["text"]]
        return {"id": batch["id"], "score": [s for s, _ in rows], "predicted": [int(s >= 0.5) for s, _ in rows], "evidence": [[{"example": e, "cosine": c} for e, c in v] for _, v in rows]}

    schema = f"id {kind}, score double, predicted int, evidence array<struct<example: {kind}, cosine: double>>"
    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), schema, run).withColumnRenamed("id", id_col)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = trained(documents, labels.where(~held_out("doc_id", 5, 0)))
    return scored(documents, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "evidence")
