"""Whole jobs over small files: every input and output layout."""

import json

from pyspark.sql import functions as F

from millrace import jobs
from millrace.sources import readers, sinks
from millrace.streaming.chunks import cluster_stream, review_counts

REVIEWS = [
    {"user_id": f"u{u}", "business_id": f"b{b}", "stars": float(1 + (u * b) % 5), "date": f"{2016 + (u + b) % 3}-01-0{1 + b}", "text": "Good food, the best!" if u % 2 else "bad (food)"}
    for u in range(8)
    for b in range(6)
    if (u + b) % 4
]


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return f"file://{path}"


def load(path):
    return json.loads(path.read_text())


def test_review_jobs(spark, tmp_path):
    reviews = lines(tmp_path / "r.json", REVIEWS)
    (tmp_path / "stop.txt").write_text("the\nbad  of")
    jobs.review_stats(spark, reviews, f"file://{tmp_path}/a.json", f"file://{tmp_path}/stop.txt", y=2017, m=2, n=3)
    out = load(tmp_path / "a.json")
    assert (out["A"], out["C"], out["E"]) == (len(REVIEWS), 8, ["food", "best", "good"]) and out["B"] == sum(r["date"] < "2018" and r["date"] >= "2017" for r in REVIEWS)
    named = lines(tmp_path / "b.json", [{"business_id": f"b{b}", "categories": "Bars, Food" if b % 2 else None, "state": "NV" if b < 3 else "AZ"} for b in range(6)])
    jobs.top_categories(spark, reviews, named, f"file://{tmp_path}/c.json")
    assert [c for c, _ in load(tmp_path / "c.json")["result"]] == ["Bars", "Food"]
    for parts in (0, 3):
        jobs.busy_businesses(spark, reviews, f"file://{tmp_path}/p.json", n=5, partitions=parts)
        out = load(tmp_path / "p.json")
        assert sum(out["n_items"]) == len(REVIEWS) and len(out["n_items"]) == out["n_partitions"] and all(n > 5 for _, n in out["result"])
    jobs.prepare_baskets(spark, reviews, named, f"file://{tmp_path}/baskets", state="NV")
    jobs.frequent_itemsets(spark, f"file://{tmp_path}/baskets", f"file://{tmp_path}/i.json", c=2, s=2)
    out = load(tmp_path / "i.json")
    assert {tuple(s) for s in out["Frequent Itemsets"]} <= {tuple(s) for s in out["Candidates"]} and out["Frequent Itemsets"]
    jobs.propagate(spark, f"file://{tmp_path}/baskets", f"file://{tmp_path}/lpa", t=2)
    jobs.split_communities(spark, f"file://{tmp_path}/baskets", f"file://{tmp_path}/gn", f"file://{tmp_path}/bt", t=2)
    found = [r.value for r in spark.read.text(f"file://{tmp_path}/gn").collect()]
    assert sorted(m for line in found for m in line.split(", ")) == [f"'u{u}'" for u in range(8)]
    assert spark.read.text(f"file://{tmp_path}/bt").count() > 0


def test_rating_jobs(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    train, test = lines(tmp_path / "train.json", REVIEWS), lines(tmp_path / "test.json", [{k: r[k] for k in ("user_id", "business_id", "stars")} for r in REVIEWS[:10]])
    users = lines(tmp_path / "users.json", [{"user_id": f"u{u}", "average_stars": 3.0} for u in range(8)])
    jobs.build_model(spark, train, at("model"), m=2)
    jobs.similar_businesses(spark, train, at("similar"), exact=True)
    jobs.predict(spark, train, test, at("model"), at("p1"))
    jobs.als(spark, train, test, at("p2"))
    jobs.blend(spark, at("p1"), at("p2"), users, at("p3"))
    jobs.evaluate(spark, at("p3"), test, at("e.json"))
    assert load(tmp_path / "e.json")["n"] == 10 and readers.json_lines(spark, at("similar"), readers.MODEL).count() > 0


def test_cluster_jobs_and_streams(spark, tmp_path):
    for r in range(3):
        (tmp_path / "points").mkdir(exist_ok=True)
        (tmp_path / "points" / f"{r}.csv").write_text("".join(f"{r}{i},{(i % 3) * 90 + i / 100},{r / 10}\n" for i in range(30)))
    at = lambda n: f"file://{tmp_path}/{n}"
    jobs.cluster(spark, at("points"), at("labels"), at("stats"), dims=2, k=3)
    assert spark.read.text(at("labels")).count() == 90 and spark.read.csv(at("stats"), header=True).count() == 3
    state = cluster_stream(spark, at("points"), 3, 2, checkpoint=at("state"))
    assert state.labels().select("id").distinct().count() == 90 and len(state.stats) == 3
    for name in ("t", "f"):
        (tmp_path / f"{name}.json").write_text(json.dumps({str(i): i % 3 for i in range(9)}))
    jobs.agreement(spark, at("t.json"), at("f.json"), at("nmi.json"))
    assert load(tmp_path / "nmi.json")["nmi"] == 1.0


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [("b1", 3.0, "2020-01-01 10:00:00"), ("b1", 4.0, "2020-01-01 12:00:00"), ("b2", 1.0, "2020-01-05 00:00:00"), ("b2", 2.0, "2020-01-09 00:00:00")]
    spark.createDataFrame(rows, "business_id string, stars double, date string").withColumn("date", F.col("date").cast("timestamp")).write.parquet(f"file://{tmp_path}/r")
    stream = spark.readStream.schema("business_id string, stars double, date timestamp").parquet(f"file://{tmp_path}/r")
    query = review_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.business_id, r.n, r.total) for r in spark.table("counts").collect()} >= {("b1", 2, 7.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("user_id,business_id\nu1,b1\nuser_id,business_id\nu2,b2\n")
    at = f"file://{tmp_path}/x.csv"
    assert [readers.csv_header(spark, at).count(), readers.csv_plain(spark, at).count(), readers.csv_without(spark, at, "user_id,business_id").count()] == [3, 4, 2]
    assert [p.rsplit("/", 1)[1] for p in readers.chunk_paths(spark, f"file://{tmp_path}")] == ["x.csv"]
    df = spark.createDataFrame([("u", "b", 1.0, 1), ("u", "b", 2.0, 2)], "user_id string, business_id string, stars double, n int")
    assert [r.stars for r in readers.last_by_key(df, ["user_id", "business_id"], "stars", ["n"]).collect()] == [2.0]
    bad = lines(tmp_path / "bad.json", [{"user_id": "u"}])
    assert readers.json_lines(spark, bad, readers.RATING).first().stars is None
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("ccc", "y")], "id string, community string")
    sinks.text_lines(sinks.community_lines(members), f"file://{tmp_path}/lines")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lines").collect()] == ["'ccc'", "'a', 'b'"]
