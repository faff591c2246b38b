"""The pipeline stage by stage against plain versions, each on its own input."""

import os

import brute

import corpus_pipeline
from millrace.llm import langid, pii
from millrace.sources import scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = [n for n, _ in corpus_pipeline.STAGES], dict(corpus_pipeline.STAGES)
    assert names == ["language", "near_copies", "benchmark", "personal_data", "sequences"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    first = stages["language"](spark, docs, SF)
    assert first.columns == docs.columns
    model = langid.trained(docs.where(~langid.held_out("doc_id", 4, 2)))
    rows = docs.collect()
    want = {r.doc_id for r, p in zip(rows, langid.predict([r.text for r in rows], model), strict=True) if not p[3]}
    assert {r.doc_id for r in first.collect()} == want and len(want) >= 0.95 * len(rows)

    second = stages["near_copies"](spark, first, SF)
    assert second.columns == docs.columns
    found = brute.near_duplicates([(r.doc_id, r.text) for r in first.collect()], 5, 80)
    kept = {i for i, (n, c) in found.items() if n == 0 or c == i}
    assert {r.doc_id for r in second.collect()} == kept and len(kept) < len(want)

    third = stages["benchmark"](spark, second, SF)
    clean = {r.doc_id for r in second.collect() if not brute.contamination(r.text, items)[1]}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean and len(clean) < len(kept)

    fourth = stages["personal_data"](spark, third, SF)
    assert fourth.columns == docs.columns
    before = {r.doc_id: r.text for r in third.collect()}
    finder = pii.Finder(pii.Field())
    for r in fourth.collect():
        assert r.n_chars == len(r.text)
        base = brute.base_spans(before[r.doc_id])
        assert not base or r.text != before[r.doc_id]
        assert not brute.base_spans(r.text) and (r.text == before[r.doc_id]) == (not finder.find([before[r.doc_id]])[0][1])

    last = stages["sequences"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == clean
    room = {}
    for r in last:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id", "piece").distinct().count() == out.count() > 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, `q``t` string, kept boolean, id string, n bigint, bands string, rank int"
LONG = " ".join(f"word{k}" for k in range(90))


def odd(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), k, f"q{k}", None, "x", k, None, 7) for k, (i, t, lang) in enumerate(rows)], ODD)


def test_stages_take_odd_documents(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = odd(spark, [(1, None, None), (2, "", "en"), (3, " \n", None), (None, LONG, "en"), (4, LONG, "en"), (5, LONG + " end", "de"), (6, "alpha beta gamma delta epsilon zeta", "en"), (6, "one two three four five six seven", "en"), (6, "one two three four five six seven", "en"), (7, "x" * 300_000, None), (8, " " * 100_000 + "a@b.co", "en"), (9, "word " * 50_000, "en")])
    columns = docs.columns
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    one = stages["near_copies"](spark, docs, SF)
    found = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in one.collect())
    assert one.columns == columns and found == [(0, "word0 wor"), (1, ""), (2, ""), (3, " \n"), (4, "word0 wor"), (6, "alpha bet"), (6, "one two t"), (7, "x" * 9), (8, " " * 9), (9, "word word")]
    clean = stages["benchmark"](spark, docs, SF)
    assert clean.columns == columns and clean.count() == docs.count()
    told = stages["personal_data"](spark, docs, SF)
    rows = {r.doc_id: r for r in told.collect()}
    assert told.columns == columns and told.count() == docs.count() and rows[1].text is None and rows[1].n_chars is None and rows[8].text.endswith("<EMAIL>") and rows[8].n_chars == len(rows[8].text)
    packed = stages["sequences"](spark, docs, SF)
    pieces = packed.collect()
    assert sum(p.piece == 0 for p in pieces) == docs.count() and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd(spark, []), SF)
        assert out.count() == 0 and (name == "sequences" or out.columns == odd(spark, []).columns)


def test_run_leaves_no_tables_but_its_result(spark):
    def tables():
        top = os.path.join(scratch.shared_dir(spark).removeprefix("file://"))
        return {os.path.join(d, x) for d in os.listdir(top) if d.startswith("millrace-") for x in os.listdir(os.path.join(top, d))}

    before = tables()
    out = corpus_pipeline.run(spark, SF)
    assert len(tables() - before) == 1 and out.count() > 0
