"""The operators of single texts against plain versions, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html, langid, licenses, media, packing, pii, toxicity

SF = "/root/testdata/sf0.001"
#: Extra columns whose names clash with those that the operators make.
CLASH = "doc_id bigint, text string, id string, n bigint, words array<string>, kept string, spans string, score double, label int, lang string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, ["y"], None, "s", 0.5, 7, None) for i, t in texts], CLASH)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 5000), (5, "word " * 30000), (5, "word"), (5, "word"), (None, "no id"), (6, "\x00 nul \x07 bell"), (7, "😀 emoji 1.2.3.4 a@b.co"), (8, "x" * 200_000)]


# Media


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 200, 1000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(64 * n)
    data = media.mux(payload)
    assert media.demux(data) == payload
    found = {b"/".join(p): body for p, body in brute.boxes(data)}
    stbl = b"moov/trak/mdia/minf/stbl/"
    assert found[b"mdat"] == payload and int.from_bytes(found[stbl + b"stsz"][8:12], "big") == n
    offsets = np.frombuffer(found[stbl + b"stco"][8:], ">u4")
    assert data[offsets[0] : offsets[0] + 64] == payload[:64] and len(offsets) == -(-n // 64)
    info = media.describe(data)
    track = info["tracks"][0]
    assert (info["brand"], track["codec"], track["duration"], track["n_samples"], track["sample_bytes"], track["n_keyframes"]) == ("isom", "raw ", n, n, 64 * n, -(-n // 64))
    assert [data[k["first"] : k["end"]] for k in track["keyframes"]] == [payload[i : i + 64] for i in range(0, 64 * n, 64 * 64)]


def test_damaged_media_gives_a_reason_and_never_fails():
    data = media.mux(bytes(range(256)) * 40)
    rng = random.Random(1)
    for _ in range(600):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        out = media.describe(bytes(broken[: rng.choice([len(broken), rng.randrange(len(broken))])]))
        assert out["error"] is None or out["tracks"] == []
    assert media.describe(None)["error"] == media.describe(b"")["error"] == "empty" and media.describe(b"GIF89a..")["error"]


def test_media_query_columns(spark):
    rows = media.media_features(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r, (i, t) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(ODD, key=lambda x: (str(x[0]), len((x[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    files = media.described(media.stored(table(spark, ODD)))
    assert files.where("error IS NOT NULL").count() == 0
    assert media.media_features(table(spark, [])).count() == 0


# Decontamination


def test_contamination_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "x9"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, " .,! "), (52, "w1 w2"), (None, "w1")]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.randrange(60))).replace("w1 ", r.choice(["W1, ", "w1-"]))) for i in range(40)]
    texts += [(90, f"before. {items[5][1].upper()}!! after"), (91, None), (92, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {x.doc_id: x for x in decontaminate.contamination(table(spark, texts), bench).collect()}
    known = [(str(i), t) for i, t in items if i is not None]
    for i, t in texts:
        n, hit, found = brute.contamination(t, known)
        x = got[i]
        assert (x.n_words, x.n_hit, x.items, x.n_items, x.contaminated) == (n, hit, found, len(found), hit > 0)
        assert x.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        covered = [w for s in x.spans for w in brute.plain_words(t.encode()[s.first : s.end].decode())]
        assert len(covered) == hit
    kept = {x.doc_id for x in decontaminate.clean(table(spark, texts), bench).collect()}
    assert kept == {i for i, x in got.items() if not x.contaminated}


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(table(spark, ODD), none).where("contaminated").count() == 0
    assert decontaminate.clean(table(spark, ODD), none).count() == len(ODD)
    assert decontaminate.contamination(table(spark, []), none).count() == 0


@pytest.mark.parametrize("common", [0, 1, 2, 64])
def test_windows_equal_brute_force_for_all_kinds_of_keys(common):
    r = random.Random(common)
    for _ in range(400):
        words = [f"w{k}" for k in range(r.choice([2, 3, 6]))]
        items = [(str(i), " ".join(r.choices(words, k=r.choice([1, 2, 4, 5, 6, 9, 12, 30])))) for i in range(r.randrange(1, 9))]
        width = r.choice([1, 2, 3, 4, 5, 10])
        text = " ".join(r.choices(words, k=r.randrange(60))) + r.choice(["", f" x {r.choice(items)[1]} y"])
        ranges, found = decontaminate.Matcher([(i, t.encode()) for i, t in items], width, common).scan(decontaminate.plain_words(text.encode()))
        n, hit, want = brute.contamination(text, items, width)
        assert sorted(found) == want and sum(b - a for a, b in decontaminate.union(ranges)) == hit, (items, text, width)


def test_a_benchmark_too_large_to_send_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="in parts"):
        decontaminate.clean(table(spark, ODD), spark.read.parquet(f"{SF}/benchmark.parquet"))


# Licences


def test_base_phrases_equal_brute_force(spark):
    r = random.Random(4)
    words = "under the MIT license Apache License, version 2 cc by nc-sa is of".split()
    texts = [(i, " ".join(r.choices(words, k=r.randrange(80)))) for i in range(60)] + [(90, "Under the\nMIT license. (CC-BY-NC) Apache License Version 2.0"), *ODD]
    known = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for x in licenses.licensed(table(spark, texts)).collect():
        wanted = []
        for i, t in texts:
            if i == x.doc_id:
                at = brute.phrases(t, known)
                wanted.append((len(brute.plain_words(t)), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))))
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) in wanted
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1


@pytest.mark.parametrize(
    ("text", "post", "labels", "permission"),
    [
        ("MIT", "MIT", {"mit"}, 1.0), ("MIT OR GPL-3.0-only", "MIT GPL-3.0-only OR", {"mit", "gpl-3"}, 1.0), ("MIT and GPL-3.0-only", "MIT GPL-3.0-only AND", {"mit", "gpl-3"}, 0.5),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT AND BSD-3-Clause", "GPL-2.0+ Classpath-exception-2.0 WITH MIT BSD-3-Clause AND OR", {"gpl-2", "mit", "bsd-3-clause"}, 1.0),
        ("(MIT OR GPL-3.0) AND CC-BY-NC-4.0", "MIT GPL-3.0 OR CC-BY-NC-4.0 AND", {"mit", "gpl-3", "cc-by-nc"}, 0.1), ("MIT) rest", "MIT", {"mit"}, 1.0), ("(MIT", "", set(), None), ("OR MIT", "", set(), None), ("", "", set(), None), ("MIT OR", "MIT", {"mit"}, 1.0),
    ],
)
def test_licence_expressions(text, post, labels, permission):
    found = licenses.postfix(licenses.tokens(text))
    assert " ".join(found) == post and licenses.evaluate(found) == (labels, permission)


def test_tags_in_texts():
    matcher = licenses.automaton()
    out = licenses.scan(matcher, b"// SPDX-License-Identifier: (Apache-2.0 OR MIT)\ncode")
    assert out["labels"] == "apache-2,mit" and out["expressions"] == ["Apache-2.0 MIT OR"] and out["permission"] == 1.0 and out["base_labels"] == ""
    assert licenses.scan(matcher, b"SPDX-License-Identifier in the text")["labels"] == ""


# Personal data


def test_base_spans_equal_their_definition():
    r = random.Random(5)
    alphabet = "a1.@+- ()9%_4é\n"
    fixed = ["a@b@c.de", "x..y@z.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0147", "+12", "a@b.c@d.e", "@", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"]
    for text in fixed + ["".join(r.choices(alphabet, k=r.randrange(120))) for _ in range(3000)]:
        got = [f"{k}:{a}:{b}" for k, spans in pii.base_spans(text).items() for a, b in spans]
        assert got == brute.base_spans(text), text


@pytest.fixture(scope="module")
def field():
    return pii.Field()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    k = 3
    moves = rng.normal(size=(k, k))
    lengths = np.array([1, 2, 5, 4])
    scores = rng.normal(size=(4, 5, k))
    got = pii.viterbi(scores, lengths, moves)
    for i, n in enumerate(lengths):
        best = max(itertools.product(range(k), repeat=int(n)), key=lambda p: sum(scores[i, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[i, :n]) == best


def test_field_finds_held_out_spans_and_leaves_clean_text(field):
    finder = pii.Finder(field)
    r = random.Random(8)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(40)]
    found = [finder.find([f'Der und token = "{h}" in the day.'])[0][1] for h in hexes]
    assert sum(any(k == "secret" and b - a == 40 for k, a, b in s) for s in found) >= 38
    clean = ["The year 1998 had 12 months and 365 days.", "Version 2.0.1 of the tool, see page 12.", "Und der die einung geverbe achlich.", "room 12-14, 3rd floor (left)"]
    assert all(not spans for _, spans in finder.find(clean))


def test_field_finds_spans_of_letters_only(field):
    texts = ["mail bob at example dot com today", "one\nreach me: carla at mail dot example dot org or later\ntwo"]
    assert [[t[a:b] for k, a, b in spans if k == "email"] for t, (_, spans) in zip(texts, pii.Finder(field).find(texts), strict=True)] == [["bob at example dot com"], ["carla at mail dot example dot org"]]


def test_spans_across_any_place_of_a_long_line(field):
    finder = pii.Finder(field)
    for n in (509, 510, 511, 1022, 3000):
        text = " ".join(itertools.islice(itertools.cycle(["and", "the", "of"]), n)) + " phone (303) 555-0199 after six" + " and the of" * 500
        assert [text[a:b] for _, a, b in finder.find([text])[0][1]] == ["(303) 555-0199"], n


def test_stretches_give_the_labels_of_whole_lines(field):
    r = random.Random(6)
    words = [w for words, _ in pii.read_table() for w in words]
    lines = [" ".join(w for _ in range(r.randrange(1, 40)) for w in (lambda at: words[at : at + r.randrange(1, 9)])(r.randrange(len(words)))) for _ in range(800)]
    scores = pii.Scores(field)
    ids = [np.array([0, *(scores[w] for w in x.split()), 0]) for x in lines]
    whole = pii.decoded([pii.sequence_scores(x, scores.table) for x in ids], field.moves)
    want = [pii.spans_of(x, [(m[0], m.start()) for m in pii._WORD.finditer(x)], y) for x, y in zip(lines, whole, strict=True)]
    assert pii.Finder(field).added(lines) == want and sum(map(len, want)) > 500


def test_words_that_share_a_row_have_the_same_features(field):
    r = random.Random(4)
    words = ["".join(r.choices("aZéÉßĀāªǅΩ漢×²٣09_-.@+=:\"'(!", k=r.randrange(1, 24))) for _ in range(20000)] + [w + m for w in (*pii.TOLD, "KEY", "\u212aey") for m in ("", ":", "!!", "%")]
    alike = pii.Alike()
    for w in words:
        assert w[slice(*pii.core(w))].lower() in pii.TOLD or pii.features(w) == pii.features(w.translate(alike)), w


def test_only_lines_that_cannot_have_labels_are_skipped(field):
    r = random.Random(2)
    words = sorted({w for words, _ in pii.read_table() for w in words})
    lines = [" ".join(r.choices(words, k=r.randrange(1, 12))) for _ in range(3000)]
    scores = pii.Scores(field)
    ids = [[0, *(scores[w] for w in x.split()), 0] for x in lines]
    best = pii.decoded([pii.sequence_scores(np.array(x), scores.table) for x in ids], field.moves)
    may = [pii.undecided(np.array(x), scores.table, pii.entering(field.moves))[1:-1] for x in ids]
    assert all(m[np.flatnonzero(b)].all() for m, b in zip(may, best, strict=True)) and 0 < sum(not m.any() for m in may)


def test_pii_rows_and_redaction(spark, field):
    texts = [*ODD, (20, "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, call +1 (212) 555-0147 now")]
    rows = pii.personal(table(spark, texts), field=field).collect()
    assert len(rows) == len(texts)
    last = next(x for x in rows if x.doc_id == 20)
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    want = ",".join(brute.base_spans(texts[-1][1]))
    assert last.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(last.spans.split(","))
    out = pii.redacted(table(spark, texts), field=field)
    assert out.columns == table(spark, []).columns and out.where("doc_id = 20").first().text == "mail <EMAIL> or <IP>, card <CARD>, call <PHONE> now"
    assert out.where("doc_id = 1").first().text is None
    assert pii.personal(table(spark, []), field=field).count() == pii.redacted(table(spark, []), field=field).count() == 0


# Language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.trained(docs.where(~langid.held_out("doc_id", 4, 2)))
    out = langid.identified(docs, model, keep=("lang",)).withColumn("held", langid.held_out("doc_id", 4, 2)).where("held AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    kept = langid.recognised(docs, model)
    assert kept.count() >= 0.99 * docs.count()


def test_language_rejects_what_is_far(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are in the house of the man", "en"), ("der hund und die katze sind in dem haus", "de")] * 30)]
    docs = spark.createDataFrame([(i, f"{t} {i % 7}", lang) for i, t, lang in rows] + [(900, None, "en"), (901, "the", None)], "doc_id bigint, text string, lang string")
    model = langid.trained(docs)
    assert model["names"] == ["de", "en"]
    got = {t: p[0] for t, p in zip(("the dog and the cat", "die katze und der hund", "1234 !! 😀", "", None), langid.predict(["the dog and the cat", "die katze und der hund", "1234 !! 😀", "", None], model), strict=True)}
    assert got == {"the dog and the cat": "en", "die katze und der hund": "de", "1234 !! 😀": "und", "": "und", None: "und"}
    assert [p[3] for p in langid.predict(["жүрөк тоолор ошол китеп алыс жерде", "the dog and the cat are in the house"], model)] == [True, False]
    assert langid.identified(table(spark, ODD), model).count() == len(ODD) and langid.identified(table(spark, []), model).count() == 0
    empty = langid.trained(docs.limit(0))
    assert {r.lang_pred for r in langid.identified(table(spark, ODD), empty).collect()} == {"und"}


def test_nearest_centroid_is_the_best_cosine():
    r = random.Random(2)
    rows = [(" ".join(r.choices(v, k=40)), lang) for lang, v in (("a", ["aba", "cab", "bac"]), ("b", ["xyx", "zzy", "yxz"]), ("c", ["abx", "cyz", "bzx"])) for _ in range(20)]
    model = langid.fit(rows)
    for text in ("aba xyx", "cab zzy zzy", "abx"):
        x = langid.vectors([langid.grams(text)], model["idf"])[0]
        cos = [float(x @ c) for c in model["centroids"]]
        assert langid.predict([text], model)[0][0] == model["names"][model["owner"][int(np.argmax(cos))]]


# Toxicity


def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        terms = sorted(rng.choice(40, rng.integers(0, 6), replace=False).tolist())
        rows.append(toxicity.unit(tuple((t, float(rng.uniform(0.1, 3))) for t in terms), 40, 1.0))
    index = toxicity.Index(rows, 41)
    dense = np.zeros((300, 41))
    for i, row in enumerate(rows):
        for t, w in row:
            dense[i, t] = w
    for q in range(0, 300, 7):
        ids, dots = index.nearest(rows[q], 15)
        want = dense @ dense[q]
        order = np.lexsort((np.arange(300), -want.round(12)))[:15]
        assert ids.tolist() == order.tolist() and np.allclose(dots, want[order])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op3_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted == 0 for r in clean) >= 0.97 * len(clean)


def test_scores_equal_dense_votes_and_are_calibrated(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained(docs, labels.where(~langid.held_out("doc_id", 5, 0)))
    # Every vector anew, as plain dictionaries.
    learnt = {r.doc_id: (r.toxic, r.text) for r in docs.join(labels, "doc_id").where(~langid.held_out("doc_id", 5, 0)).where("toxic IS NOT NULL").select("doc_id", "toxic", "text").collect()}

    def vector(text):
        w = toxicity.words((text or "").encode())
        found = [t for x in w for t in toxicity.terms_of(x) if t in model.numbers]
        v = {t: 100 * found.count(t) / len(w) * model.worth[model.numbers[t]] for t in found}
        norm = sum(x * x for x in v.values()) + model.weight**2
        return {t: x / norm**0.5 for t, x in v.items()} | {None: model.weight / norm**0.5}

    groups = {}
    for key, (y, text) in learnt.items():
        v = vector(text)
        g = groups.setdefault(tuple(sorted((str(t), round(x, 9)) for t, x in v.items())), [v, [0, 0], key])
        g[1][y] += 1
        g[2] = min(g[2], key)
    assert len(groups) == len(model.votes)
    rows = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for d in docs.where("doc_id % 9 = 0").collect():
        v = vector(d.text)
        near = sorted(((sum(x * g[0].get(t, 0) for t, x in v.items()), g[2], g[1]) for g in groups.values()), key=lambda x: -x[0])[: toxicity.NEIGHBOURS]
        weight = [1 / (1.01 - min(c, 1)) ** 2 for c, _, _ in near]
        p = (sum(w * n[1] for w, (_, _, n) in zip(weight, near, strict=True)) + model.prior) / (sum(w * sum(n) for w, (_, _, n) in zip(weight, near, strict=True)) + 1)
        z = model.curve[0] * np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))) + model.curve[1]
        got = rows[d.doc_id]
        assert abs(got.score - 1 / (1 + np.exp(-z))) < 1e-3 and np.allclose([e.cosine for e in got.evidence], [c for c, _, _ in near[:3]], atol=1e-9)
        assert all(e.example in learnt for e in got.evidence)
    truth = {r.doc_id: r.toxic for r in labels.where(langid.held_out("doc_id", 5, 0)).where("toxic IS NOT NULL").collect()}
    told = [(rows[k].score, y) for k, y in truth.items() if k in rows]
    bins = [[(s, y) for s, y in told if min(int(s * 10), 9) == b] for b in range(10)]
    error = sum(abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins) / len(told)
    assert error < 0.08


def test_rare_telling_terms_are_kept(spark):
    """Hundreds of telling words, each in one of forty examples: none is left out for the sake of others."""
    r = random.Random(5)
    plain = [f"word{k}" for k in range(300)]
    bad = [f"{a}{b}{c}ugh" for a in "zqx" for b in "aeiou" for c in range(30)]
    docs, labels = [], []
    for i in range(6000):
        y = i % 2
        text = r.choices(plain, k=20) + (r.choices(bad, k=12) if y else [])
        docs.append((i, " ".join(text)))
        labels.append((i, y))
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.trained(table(spark, docs), labels.where("doc_id < 5000"), positive=10**6, negative=10**6)
    assert all(b.encode() in model.numbers for b in bad) and len(bad) == 450
    rows = [x for x in toxicity.scored(table(spark, docs), model).collect() if x.doc_id >= 5000]
    assert sum(x.predicted == x.doc_id % 2 for x in rows) >= 0.99 * len(rows)


def test_toxicity_of_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.trained(table(spark, ODD), labels)
    rows = toxicity.scored(table(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.trained(table(spark, ODD), labels.limit(0))
    assert {r.score for r in toxicity.scored(table(spark, ODD), nothing).collect()} == {0.0}
    assert toxicity.scored(table(spark, []), model).count() == 0


# Packing


def test_tokens_equal_the_named_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [(30, "a b  c\r\n\r\n  d̀e ½ ² ٣ x​y"), (31, "I'll we've 'S it's   \t\t end ")]
    rows = packing.tokenized(table(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), "doc_id", "text", 10**9, 0).collect()
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts for ids in [[*named.encode(t or "", add_special_tokens=False).ids, 0]])
    assert sorted((str(r.id), r.length, r.ids_crc32) for r in rows) == want


def test_added_tokens_are_found_in_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r, end = random.Random(7), "<|endoftext|>"
    texts = [f"end of it {end} next", end, f"{end}{end}", f"a  {end}  b\n\n{end}\n c{end}d", f"<|{end}|>", end[:-1], end.upper(), f"<|endoftext{end}"]
    texts = list(enumerate(texts + ["".join(r.choices([end, " ", "  ", "\n", "a", "'s", "9", "é", "<|", "|>", "endoftext"], k=r.randrange(1, 20))) for _ in range(300)]))
    rows = packing.tokenized(table(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), "doc_id", "text", 10**9, 0).collect()
    want = {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts for ids in [[*named.encode(t, add_special_tokens=False).ids, 0]]}
    assert {r.id: (r.length, r.ids_crc32) for r in rows} == want and want[0][0] == 7


def test_packing_places_every_piece_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(table(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = packing.packed(docs, room=512).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
        total += at
    assert len(by) <= 1.02 * -(-total // 512) + 1
    one = [r for r in rows if r.doc_id == 10**6 + 4]
    assert [r.start for r in sorted(one, key=lambda r: r.piece)] == list(itertools.accumulate([0] + [r.length for r in sorted(one, key=lambda r: r.piece)][:-1]))
    assert all(r.length == 512 for r in one if r.piece > 0)
    assert packing.packed(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_uses_each_length_as_often(seed):
    r = random.Random(seed)
    room = 50
    lengths = [r.randrange(1, room + 1) for _ in range(r.choice([1, 5, 400]))]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    used = {}
    patterns = packing.best_two_fit(histogram, room)
    for times, chosen in patterns:
        assert 0 < sum(chosen) <= room
        for k in chosen:
            used[k] = used.get(k, 0) + times
    assert used == histogram
    assert sum(t for t, _ in patterns) <= 1.05 * sum(lengths) / room + 2 + sum(k > room // 2 for k in lengths)


def test_two_that_fit_better_replace_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, (6, 2, 2)), (1, (3,))]


# Pages


def page(i, host, body, side=""):
    return (i, f"https://{host}/p/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>home</a></nav><header>Site</header>{side}{body}<footer>&copy; foot</footer><script>var x='<p>no</p>';</script></body></html>")


def test_main_text(spark):
    long_ = "A sentence with some words, and more of them, so that it weighs enough to win. " * 3
    rows = [page(i, "x.example", f"<div class='post-{i}'><h1>Head {i}</h1><p>{long_}&amp; é&#233;</p><p>Short  one.<br>here</p><div class=comments><p>{long_}</p></div></div>", f"<div class=sidebar><p>{long_}</p></div>") for i in range(6)]
    rows += [(90, None, None), (91, "bad url", ""), (92, "https://y.example/", "plain &lt;text&gt; <b>only</b>"), (93, "https://y.example/2", "<p>unclosed <div><p>deep</div> tail <!-- c --> &nope; <script>never ends"), (93, "https://y.example/2", "<p>twin")]
    got = main = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    at = {(r.page_id, r.url): r for r in main if r.page_id != 93}
    for i in range(6):
        r = at[i, f"https://x.example/p/{i}"]
        assert r.text == f"Head {i}\n\n{long_}& éé\n\nShort one. here" and r.n_chars == len(r.text)
    assert at[90, None].text == at[91, "bad url"].text == "" and at[92, "https://y.example/"].text == "plain <text> only"
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_odd_nesting_never_fails():
    r = random.Random(9)
    parts = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<script>", "</script>", "<!--", "-->", "text & more", "&lt;", "<a href='x'>", "</a>", "<", ">", "<div class='a", "<article>", "</article>", "<![CDATA[z]]>"]
    for _ in range(500):
        for b in html.blocks("".join(r.choices(parts, k=r.randrange(30)))):
            assert b.text and b.text == " ".join(b.text.split())


def test_empty_text_columns_stay_defined(spark):
    docs = table(spark, ODD).withColumn("text", F.lit(None).cast("string"))
    assert {r.n_words for r in licenses.licensed(docs).collect()} == {0}
    assert {r.n_bytes for r in media.media_features(docs).collect()} == {0}
    assert packing.packed(docs).agg(F.max("length")).first()[0] == 1


@pytest.mark.parametrize(
    ("name", "tag", "in_article", "want"),
    [("ad", "div", False, "outside"), ("top-ad-box", "div", True, "outside"), ("adBox", "div", False, "outside"), ("cookie-notice", "div", True, "outside"), ("notice-period", "p", True, ""), ("share-price", "div", True, ""), ("post-header", "div", False, ""), ("header", "div", True, ""), ("site-header", "div", False, "outside"),
     ("main-menu", "ul", True, "outside"), ("sidebar-left", "div", False, "outside"), ("no-sidebar", "div", False, ""), ("comments-area", "section", True, "comments"), ("comment", "article", True, "comments"), ("shadow", "div", False, ""), ("reading", "p", True, ""), ("footer-links", "div", True, "outside"), ("post-content", "div", False, "")],
)
def test_names_of_elements(name, tag, in_article, want):
    assert html.names(tag, {"class": f"x {name}"}, in_article) == want == html.names(tag, {"id": name}, in_article)


def built(r, words):
    """A random page, and the text of its article."""
    text, parts = [], []

    def drawn(n):
        return " ".join(r.choices(words, k=n))

    def escaped(x):
        return x.replace("&", "&amp;").replace("<", "&lt;")

    def some(n):
        return escaped(drawn(n))

    def told(n):
        text.append(drawn(n))
        return escaped(text[-1])

    parts.append(f"<h1>{told(6)}</h1>")
    for _ in range(r.randrange(3, 9)):
        kind = r.randrange(5)
        if kind == 0:
            parts.append(f"<section><h2>{told(4)}</h2><p>{told(30)}</p></section>")
        elif kind == 1:
            parts.append(f"<ul><li>{told(9)}<li>{told(8)}</ul>")
        elif kind == 2:
            parts.append(f"<blockquote class='pull-quote'><p>{told(25)}</blockquote>")
        elif kind == 3:
            a, b = drawn(12), drawn(10)
            text.append(f"{a} {b}")
            parts.append(f"<p>{escaped(a)} <b>{escaped(b)}</b>")
        else:
            parts.append(f"<p>{told(35)}</p>")
        parts.append(r.choice(["", f"<div class='ad-slot'>{some(8)}</div>", "<!-- x --><script>var p = '<p>no</p>';</script>", f"<aside><p>{some(20)}</p></aside>", f"<form><p>{some(5)}</p><input value='x'></form>", "\n  "]))
    top = f"<header><p>{some(4)}</p></header><nav><ul>" + "".join(f"<li><a href='/{k}'>{some(2)}</a></li>" for k in range(6)) + f"</ul></nav><div class='cookie-notice'><p>{some(40)}</p></div>"
    end = f"<div class='comment-list'><article class='comment'><p>{some(60)}</p></article></div><footer><p>{some(20)}</p></footer>"
    side = f"<div class='sidebar'><h3>{some(3)}</h3><p>{some(50)}</p></div>"
    around = r.choice(["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div class='entry-content'>{}</div>", "<form action='/'><div id='main'><article>{}</article></div></form>"])
    return f"<!doctype html><html><head><title>{some(3)}</title></head><body>{top}{side}{around.format(''.join(parts))}{end}</body></html>", "\n\n".join(text)


def test_articles_of_built_pages_come_back_whole(spark):
    r = random.Random(11)
    words = ["alpha", "beta,", "gamma.", "R&D", "a<b", "é", "naïve", "x&y", "menu", "advert", "comments"]
    pages = [built(r, words) for _ in range(120)]
    rows = [(i, f"https://host{i % 7}.example/{i}", p, "clash", 3) for i, (p, _) in enumerate(pages)]
    got = {x.page_id: x for x in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, `a.b` int")).collect()}
    for i, (_, text) in enumerate(pages):
        assert got[i].text == text and got[i].n_chars == len(text)


def test_one_host_is_one_vote(spark):
    long_ = "Words that weigh enough to win the page, and more of them. " * 4
    good, bad = f"<div class=story><p>{long_}</p></div><div class=x><p>{long_}{long_}</p></div>", f"<div class=story><p>{long_}{long_}</p></div><div class=x><p>{long_}</p></div>"
    rows = [(i, f"https://u@{'EXAMPLE' if i % 2 else 'example'}.org:80/{i}", good if i == 0 else bad) for i in range(5)] + [(9, "https://İstanbul.example/", good), (10, "https://İstanbul.example/", bad)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[i].path for i in range(5)} == {"/div.story"} and got[0].text == long_.strip()
    assert got[9].path == got[10].path
