"""Language identification: TF-IDF vectors of letter n-grams compared with several clustered centroids per language."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_filter, arrow_map

BINS, CENTROIDS = 1 << 13, 4
#: Expected number of texts per language that the fit takes.
SAMPLE = 400
#: Of these texts, so many of each language are cut into pieces, which show how far clean short texts may be.
PIECED = 100
MOST_LANGUAGES = 1000
#: A text is rejected if its best cosine is below this part of the least one of the sample's texts, and pieces of them, of its length.
SLACK = 0.5
#: No text of a larger cosine is rejected, however much nearer the sample's texts of its length are.
NEAR = 0.2

_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, where each run of others than letters is one space; it begins and ends with a space."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[0][np.minimum(c, 65535)]
    if (high := c >= 1 << 16).any():
        codes, which = np.unique(c[high], return_inverse=True)
        letter[high] = np.array([chr(x).isalpha() for x in codes.tolist()])[which]
    c = np.where(letter, c, 32).astype(np.uint32)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def grams(text: str | None) -> np.ndarray:
    """Hashed bins of all 1-, 2- and 3-grams; none for a text without letters."""
    c = letters(text or "").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint16)
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    one, two = c[1:-1] * k[0], c[:-1] * k[1] + c[1:] * k[2]
    three = c[:-2] * k[2] + c[1:-1] * k[0] + c[2:] * k[1]
    h = np.concatenate([one, two ^ np.uint64(1 << 40), three ^ np.uint64(1 << 41)])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 13)).astype(np.uint16)


def vectors(bins: Sequence[np.ndarray], idf: np.ndarray | None = None) -> np.ndarray:
    """Rows: 1 + log of counts, times idf, of length 1; a row without n-grams is 0."""
    x = np.zeros((len(bins), BINS), np.float32)
    for i, b in enumerate(bins):
        x[i] = np.bincount(b, minlength=BINS)
    np.log1p(x, out=x)
    if idf is not None:
        x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread-out rows."""
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c


def fit(rows: list[tuple[str, str]]) -> dict:
    """rows: (text, lang). Centroids with their languages, idf, the least cosine of clean pieces by the logarithm of length, and the softmax's scale."""
    bins, langs = [], []
    for text, lang in sorted(rows, key=lambda r: (r[1], r[0])):
        if len(b := grams(text)):
            bins.append(b)
            langs.append(lang)
    names = sorted(set(langs))
    if not names:
        return {"names": [], "owner": np.zeros(0, int), "centroids": np.zeros((0, BINS), np.float32), "idf": np.ones(BINS, np.float32), "least": np.zeros(32), "scale": 1.0}
    seen = np.zeros(BINS)
    for b in bins:
        seen[np.unique(b)] += 1
    idf = (np.log((1 + len(bins)) / (1 + seen)) + 1).astype(np.float32)
    y = np.array([names.index(v) for v in langs])
    sums, owner = [], []
    for j in range(len(names)):
        x = vectors([b for b, v in zip(bins, y, strict=True) if v == j], idf)
        c = clusters(x, CENTROIDS)
        sums.append(c)
        owner += [j] * len(c)
    model = {"names": names, "owner": np.array(owner), "centroids": np.concatenate(sums), "idf": idf}
    # The texts themselves and pieces of 1, 2, 4, ... words show how low the cosine of a clean text of each length may be.
    least = np.full(32, np.inf)

    def cut(words: list[str]):
        for e in range(9):
            for s in range(0, max(1, len(words) - 2**e + 1), max(1, len(words) // 6)):
                yield grams(" ".join(words[s : s + 2**e]))

    def pieces():
        yield from bins
        for _, own in itertools.groupby(sorted((lang, text) for text, lang in rows), key=lambda r: r[0]):
            own = list(own)
            for at in np.linspace(0, len(own) - 1, min(PIECED, len(own))).astype(int).tolist():
                yield from cut(own[at][1].split())

    for part in itertools.batched(filter(len, pieces()), 256):
        cos = (vectors(part, idf) @ model["centroids"].T).max(1)
        np.minimum.at(least, [len(p).bit_length() for p in part], cos)
    # A longer text may be no farther than a shorter one may; texts shorter than all that were seen are never rejected.
    seen = np.flatnonzero(np.isfinite(least))
    least[seen[-1] + 1 :] = least[seen[-1]]
    least = np.minimum(np.minimum.accumulate(least[::-1])[::-1] * SLACK, NEAR)
    least[: seen[0]] = 0
    model["least"] = least
    best = per_language(vectors(bins[:: max(1, len(bins) // 500)], idf), model)
    truth = y[:: max(1, len(bins) // 500)]
    model["scale"] = min((5.0, 10.0, 20.0, 40.0, 80.0), key=lambda s: -np.log(np.maximum(softmax(best * s)[np.arange(len(truth)), truth], 1e-9)).mean())
    return model


def per_language(x: np.ndarray, model: dict) -> np.ndarray:
    cos = x @ model["centroids"].T
    return np.stack([cos[:, model["owner"] == j].max(1) for j in range(len(model["names"]))], 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(texts: list[str | None], model: dict) -> list[tuple[str, float, float, bool]]:
    """(language or und, score, cosine, rejected) of each text."""
    out: list[tuple[str, float, float, bool]] = []
    for low in range(0, len(texts), 128):
        bins = [grams(t) for t in texts[low : low + 128]]
        if not model["names"]:
            out += [("und", 0.0, 0.0, True)] * len(bins)
            continue
        best = per_language(vectors(bins, model["idf"]), model)
        sure, top = softmax(best * model["scale"]), best.argmax(1)
        for b, p, cos, j in zip(bins, sure, best, top.tolist(), strict=True):
            if len(b):
                out.append((model["names"][j], float(p[j]), float(cos[j]), bool(cos[j] < model["least"][len(b).bit_length()])))
            else:
                out.append(("und", 0.0, 0.0, True))
    return out


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def trained(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """The model of about `sample` distinct texts of each language, chosen by a hash of the text (all of a language that has fewer)."""
    told = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"))
    counts = told.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return fit([])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], float(min(1.0, sample / max(1, r["n"])) * 2**30))))
    chosen = told.where(F.pmod("h", F.lit(1 << 30)) <= share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return fit([(r["text"], r["lang"]) for r in chosen.select("text", "lang").toLocalIterator()])


def identified(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns `keep`, lang_pred, score, cosine and rejected for every row. Null texts and texts without letters: und, score 0, rejected. A model without languages rejects all."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds, names = dict(documents.dtypes), [id_col, *keep]

    def run(batch: dict[str, list]) -> dict[str, list]:
        rows = predict(batch["__text"], shared.value)
        return {k: batch[k] for k in names} | {k: [r[i] for r in rows] for i, k in enumerate(("lang_pred", "score", "cosine", "rejected"))}

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", lang_pred string, score double, cosine double, rejected boolean"
    return arrow_map(documents.select(*names, F.col(text_col).alias("__text")), schema, run)


def op4_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(documents.where(~held_out("doc_id", 4, 2)))
    return identified(documents, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def recognised(documents: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """documents without the rows whose text the model rejects; null texts are rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(documents, text_col, lambda texts: [not r[3] for r in predict(texts, shared.value)])
