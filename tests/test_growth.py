"""What tasks hold and send on larger inputs."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import itemsets, pairs, similarity
from millrace.plans import catalogue
from millrace.sources import readers
from millrace.sources.scratch import new_path, written

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("value", [None, "v"])
def test_pairs_are_formed_after_the_shuffle_in_tasks_of_bounded_size(spark, monkeypatch, value):
    sets = {f"e{i}": {f"k{(i * j) % 17}" for j in range(1, 6)} for i in range(40)}
    rows = written(spark.createDataFrame([(e, k, float(len(k))) for e, ks in sets.items() for k in ks], "e string, k string, v double"))
    formed = sum(n * (n - 1) // 2 for n in (sum(k in s for s in sets.values()) for k in {k for s in sets.values() for k in s}))
    monkeypatch.setattr(pairs, "PAIRS_A_TASK", 50, raising=False)
    found = pairs.shared_keys(rows, "e", "k", 3, value)
    assert f", {-(-formed // 50)}), REPARTITION_BY_NUM" in re.sub(r"#\d+", "", plan_of(found))
    assert {(r.a, r.b): r.n for r in found.collect()} == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 3}


def test_given_pairs_stay_one_row_each(spark):
    rows = spark.createDataFrame([(e, k) for e in range(3) for k in range(e, 50)], "e int, k int")
    asked = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a int, b int")
    found = similarity.verified(asked, written(rows), "e", "k", 0.97)
    assert "array_intersect" in plan_of(found)
    assert {(r.a, r.b): r.sim for r in found.collect()} == {(0, 1): 49 / 50, (1, 2): 48 / 49}


def test_plain_csv_is_written_by_many_tasks_with_one_header(spark):
    from millrace.sources import sinks

    path = new_path(spark)
    sinks.csv_one_header(spark.range(40).repartition(4).select(F.col("id").alias("user_id"), F.col("id").alias("business_id")), path)
    assert len([p for p in readers.chunk_paths(spark, path) if p.endswith(".csv")]) == 5
    got = [(r.user_id, r.business_id) for r in readers.csv_plain(spark, path).collect()]
    assert got.count(("user_id", "business_id")) == 1 and sorted(got) == sorted([("user_id", "business_id")] + [(str(i), str(i)) for i in range(40)])
    assert "Coalesce" not in plan_of(catalogue.QUERIES["op_csv_plain"](spark, SF))


def test_trees_of_fp_growth_hold_items_of_frequent_pairs_only(spark, monkeypatch):
    from pyspark.ml import fpm

    grown = []
    monkeypatch.setattr(fpm.FPGrowth, "fit", lambda self, df, fit=fpm.FPGrowth.fit: grown.append((df, self.getNumPartitions())) or fit(self, df))
    monkeypatch.setattr(itemsets, "BASKETS_A_TREE", 3, raising=False)
    rows = spark.createDataFrame([(b, f"i{x}") for b in range(30) for x in {b % 7, 7 + b % 2, 9 + b % 2, 11 + b % 5}], "basket int, item string")
    for support in (4, 5, 20):
        want = sorted((r["items"], r.n) for r in itemsets.frequent_itemsets(rows, support).collect())
        assert sorted((r["items"], r.n) for r in itemsets.frequent_itemsets_fp(rows, support).collect()) == want
    assert len(grown) == 2 and {x for r in grown[1][0].collect() for x in r["items"]} == {"i7", "i8", "i9", "i10"} and grown[1][1] == 10
