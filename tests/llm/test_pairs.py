import os
import random
import subprocess
import sys

import pytest
from brute import near_duplicates as brute_near
from brute import repeated_words as brute_repeated

from millrace.llm import substring
from millrace.llm.neardup import near_duplicates, sharing_rare
from millrace.llm.substring import repeated_words

SCHEMA = "doc_id bigint, text string, n bigint, id string, set string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)


def corpus(seed, docs=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "Ünï", "a", "A"]
    rows, texts = [], []
    for i in range(docs):
        kind = r.random()
        if kind < 0.3 and texts:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            t = r.choice([" ", "\n", " \t "]).join(w)
        elif kind < 0.5 and texts:
            w = r.choice(texts).split()
            k = r.randrange(max(1, len(w)))
            t = " ".join(r.choices(vocabulary, k=r.randrange(30)) + w[k : k + r.randrange(20, 90)] + r.choices(vocabulary, k=r.randrange(30)))
        elif kind < 0.6:
            t = " ".join([r.choice("ab")] * r.randrange(1, 130))
        elif kind < 0.65:
            t = " ".join(["x", "y"] * r.randrange(1, 80))
        elif kind < 0.7:
            t = r.choice([None, "", " \n ", "one", "one two", "ONE two"])
        else:
            t = " ".join(r.choices(vocabulary, k=r.randrange(1, 160)))
        texts.append(t or "")
        rows.append((i * 3 + 1, t))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute_near(rows, 3, 85)
    got = near_duplicates(table(spark, rows), width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_repeated_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = repeated_words(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeated(rows, 50)
    assert sum(r.n_removed for r in got) > 500


def test_empty_null_and_repeated_rows(spark):
    empty = table(spark, [])
    assert near_duplicates(empty).count() == 0 and repeated_words(empty).count() == 0
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long_), (None, None), (7, long_), (7, long_), (9, long_), (3, ""), (3, None), (8, long_ + " end")]
    near = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(table(spark, rows)).collect())
    assert near == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]
    cut = sorted((r.doc_id or 0, r.n_removed) for r in repeated_words(table(spark, rows)).collect())
    assert cut == [(0, 0), (0, 0), (3, 0), (3, 0), (7, 0), (7, 0), (8, 60), (9, 60)]


def near_copies(seed, docs, words, edits):
    """Copies of one text, each with so many random words put in, taken out or changed."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(docs):
        w = list(base)
        for _ in range(r.choice(edits)):
            at = r.randrange(len(w))
            kind = r.random()
            w[at : at + (kind < 0.7)] = [] if kind < 0.2 else [f"x{r.randrange(10**6)}"] if kind < 0.9 else [r.choice(base)]
        rows.append((i + 1, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "edits"), [(1, [2, 3, 4]), (2, [0, 1, 5, 9]), (3, [4, 5]), (4, [3])])
def test_groups_around_the_threshold(spark, seed, edits):
    rows = near_copies(seed, 120, 120, edits)
    got = near_duplicates(table(spark, rows), width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 3, 85)


def test_rare_shingles_find_all_pairs_and_few_more(spark):
    rows = near_copies(7, 200, 100, [1, 2, 3, 4, 6, 8])
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    number = {s: k for k, s in enumerate({s for x in sets.values() for s in x})}
    df = spark.createDataFrame([(i, i, [number[s] for s in x]) for i, x in sets.items()], "id bigint, component bigint, set array<bigint>")
    found = {(r.a, r.b) for r in sharing_rare(df, 85).collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert alike <= found and len(found) <= 4 * len(alike)


@pytest.mark.parametrize("seed", [7, 8])
def test_passages_that_many_documents_share(spark, seed):
    r = random.Random(seed)
    passages = [[f"p{p}x{k}" for k in range(r.choice([49, 50, 51, 70, 130]))] for p in range(4)] + [["same"] * 80, ["a", "b"] * 40]
    rows = []
    for i in range(150):
        w = []
        for _ in range(r.randrange(1, 4)):
            w += [f"u{r.randrange(10**6)}" for _ in range(r.randrange(40))]
            p = r.choice(passages)
            low = r.choice([0, 0, 0, r.randrange(20)])
            w += p[low : len(p) - r.choice([0, 0, r.randrange(10)])]
        rows.append((1000 - i, " ".join(w)))
    got = repeated_words(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeated(rows, 50)


@pytest.mark.parametrize("seed", [9, 10])
def test_long_texts_go_in_pieces(spark, monkeypatch, seed):
    """Texts of many pieces, and symbols spread out a few at a time, give the same rows."""
    monkeypatch.setattr(substring, "LONG", 400)
    monkeypatch.setattr(substring, "EXPANDED", 300)
    r = random.Random(seed)
    passages = [[f"p{p}x{k}" for k in range(r.choice([50, 51, 130, 400]))] for p in range(3)] + [["same"] * 300, ["a", "b"] * 140]
    rows = []
    for i in range(60):
        w = [x for _ in range(r.randrange(1, 5)) for x in ([f"u{r.randrange(10**6)}" for _ in range(r.randrange(200))] + r.choice(passages)[r.randrange(30) :])]
        rows.append((1000 - i, " ".join(w).replace("u1", "\n u1")))
    got = repeated_words(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeated(rows, 50)


def test_memory_of_one_repetitive_text():
    """Of 50 MB of one word, with 1 GB for the process."""
    code = """
import resource
from millrace.llm import substring as s
resource.setrlimit(resource.RLIMIT_DATA, (1 << 30, 1 << 30))
text = b"a " * 25_000_000
n = sum(len(s.anchors(words, at, 50)[0]) for words, at, _, _ in s.pieces([text], 50))
print(n, s.read(text)[0])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env=os.environ | {"OPENBLAS_NUM_THREADS": "1"}, timeout=600)
    assert out.stdout.split() == ["24999951", "25000000"], out.stderr
