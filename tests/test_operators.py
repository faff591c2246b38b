"""Operators against plain Python on small random inputs, and on the edge cases of nulls, ties, repeated rows and empty tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import bfr, graph, itemsets, metrics, pairs, recommend, similarity, stats


def sets_of(seed, n=40, keys=25):
    r = random.Random(seed)
    return {f"e{i}": {f"k{int(abs(r.gauss(0, 6)))}" for _ in range(r.randrange(1, 12))} for i in range(n)}


def flat(spark, sets, a="e", b="k"):
    return spark.createDataFrame([(e, k) for e, ks in sets.items() for k in sorted(ks)], f"{a} string, {b} string")


@pytest.mark.parametrize("heavy", [1000, 5, 0])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_shared_keys(spark, heavy, least):
    sets = sets_of(least)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    got = pairs.shared_keys(flat(spark, sets), "e", "k", least, heavy=heavy).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("heavy", [1000, 4])
def test_shared_keys_with_values_and_nulls(spark, heavy):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("a", "y", 3.0), ("b", "y", 5.0), ("c", "y", 1.0), (None, "y", 1.0), ("a", None, 1.0), ("b", None, 1.0), *[(f"z{i}", "y", 1.0) for i in range(5)]]
    got = pairs.shared_keys(spark.createDataFrame(rows, "e string, k string, v double"), "e", "k", 2, "v", heavy=heavy).collect()
    assert [(r.a, r.b, r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy) for r in got] == [("a", "b", 2, 4.0, 7.0, 10.0, 29.0, 17.0)]


@pytest.mark.parametrize("heavy", [1000, 3])
def test_jaccard_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(pairs.shared_keys, "__defaults__", (1, None, heavy))
    sets = sets_of(7)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    got = similarity.jaccard_pairs(flat(spark, sets), "e", "k", 0.4).collect()
    assert {(r.a, r.b): pytest.approx(r.sim) for r in got} == {p: s for p, s in want.items() if s >= 0.4}


def test_minhash_pairs_are_exact_ones(spark):
    sets = sets_of(8)
    sets["copy"] = set(sets["e1"])
    exact = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(flat(spark, sets), "e", "k", 0.3).collect()}
    found = {(r.a, r.b): r.sim for r in similarity.lsh_jaccard_pairs(flat(spark, sets), "e", "k", 0.3, 20, 2, seed=3).collect()}
    assert found.items() <= exact.items() and ("copy", "e1") in found
    strong = {p for p, s in exact.items() if s >= 0.8}
    assert len(strong & set(found)) >= 0.9 * len(strong)


def brute_itemsets(baskets, support, most):
    counts = Counter(c for b in baskets for k in range(1, most + 1) for c in itertools.combinations(sorted(b), k))
    return {c: n for c, n in counts.items() if n >= support}


@pytest.mark.parametrize("seed", [1, 2])
def test_frequent_itemsets(spark, seed):
    sets = sets_of(seed)
    rows = flat(spark, sets, "basket", "item")
    want = brute_itemsets(sets.values(), 5, 4)
    for found in (itemsets.frequent_itemsets(rows, 5, 4), itemsets.frequent_itemsets_fp(rows, 5, 4)):
        assert {tuple(r["items"]): r.n for r in found.collect()} == want
    local = itemsets.local_candidates(rows, 5, 3, 4)
    assert set(want) <= {tuple(r["items"]) for r in local.collect()}
    assert {tuple(r["items"]): r.n for r in itemsets.counted_candidates(rows, local, 5).collect()} == want


def test_itemsets_of_nothing(spark):
    rows = itemsets.basket_rows(spark.createDataFrame([(None, "a"), ("x", None)], "b string, i string"), "b", "i")
    assert rows.count() == itemsets.frequent_itemsets(rows, 1).count() == itemsets.frequent_itemsets_fp(rows, 1).count() == 0
    twice = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "a")], "b string, i string")
    assert sorted(map(tuple, itemsets.basket_rows(twice, "b", "i", more_than=2).collect())) == [("x", "a"), ("x", "b")]


TOY = "ed ef df dg db fg gh ba bc ac ci hi".split()


def toy(spark):
    return spark.createDataFrame([tuple(sorted(e)) for e in TOY], "src string, dst string")


@pytest.mark.parametrize("most", [1000, 0])
def test_betweenness_of_a_known_graph(spark, most):
    want = dict(zip("ab ac bc bd ci de df dg ef fg gh hi".split(), [5.0, 3.0, 6.833333, 12.833333, 6.833333, 5.666667, 4.0, 6.833333, 2.333333, 4.333333, 8.166667, 7.166667], strict=True))
    got = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(toy(spark), most=most).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    one = spark.createDataFrame([("e",)], "id string")
    alone = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(toy(spark), one, halved=False, most=most).collect()}
    assert alone["de"] == pytest.approx(5.666667, abs=1e-6) and alone["bd"] == pytest.approx(3.333333, abs=1e-6) and "ac" not in alone


def parts_of(vertices, edges):
    root = {v: v for v in vertices}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in vertices}


def random_edges(seed, n=24, m=30):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample([f"v{i:02d}" for i in range(n)], 2))) for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_degrees(spark, seed):
    edges = random_edges(seed, 40, 28)
    vertices = {f"v{i:02d}" for i in range(40)}
    df = spark.createDataFrame(edges, "src string, dst string")
    every = spark.createDataFrame([(v,) for v in vertices], "id string")
    assert {r.id: r.component for r in graph.components(df, every).collect()} == parts_of(vertices, edges)
    assert {r.id: r.degree for r in graph.degrees(df).collect()} == Counter(v for e in edges for v in e)


def brute_betweenness(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = dict.fromkeys(edges, 0.0)
    for s in near:
        level, paths, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in near[w]:
                if level.get(v) == level[w] - 1:
                    share = credit[w] * paths[v] / paths[w]
                    credit[v] += share
                    out[tuple(sorted((v, w)))] += share / 2
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 1000), (2, 1000), (3, 0)])
def test_betweenness_equals_brute_force(spark, seed, most):
    """Graphs of several components, with names and with numbers; sources that are in no edge add nothing."""
    edges = random_edges(seed)
    want = {e: pytest.approx(v, abs=1e-9) for e, v in brute_betweenness(edges).items()}
    assert {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(spark.createDataFrame(edges, "src string, dst string"), most=most).collect()} == want
    numbers = [(int(a[1:]), int(b[1:])) for a, b in edges]
    sources = spark.createDataFrame([(v,) for v in [*range(24), 99]], "id bigint")
    got = graph.edge_betweenness(spark.createDataFrame(numbers, "src bigint, dst bigint"), sources, most=most).collect()
    assert {(f"v{r.src:02d}", f"v{r.dst:02d}"): r.betweenness for r in got} == want


def brute_split(edges):
    vertices, m = {v for e in edges for v in e}, len(edges)
    left, best = list(edges), None
    while True:
        part = parts_of(vertices, left)
        degree = Counter(v for e in left for v in e)
        q = 0.0
        for c in set(part.values()):
            inner = sum(part[a] == part[b] == c for a, b in edges)
            q += inner / m - (sum(degree[v] for v in vertices if part[v] == c) / (2 * m)) ** 2
        if best is None or q > best[0] + 1e-12:
            best = (q, part)
        if not left:
            return best
        values = brute_betweenness(left)
        left.remove(min(left, key=lambda e: (-round(values[e], 9), e)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_girvan_newman_equals_brute_force(spark, seed):
    edges = random_edges(seed)
    q, want = brute_split(edges)
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.id: r.community for r in graph.girvan_newman(df).collect()} == want
    textbook = graph.modularity(graph.girvan_newman(df), df).first().q
    degree = Counter(v for e in edges for v in e)
    inner = sum(want[a] == want[b] for a, b in edges) / len(edges)
    assert textbook == pytest.approx(inner - sum((sum(degree[v] for v in want if want[v] == c) / (2 * len(edges))) ** 2 for c in set(want.values())))


@pytest.mark.parametrize("seed", [4, 5])
def test_girvan_newman_puts_components_in_order(spark, seed):
    """Graphs of several components, one twice, so that removals tie across them."""
    edges = random_edges(seed, 36, 34)
    twin = random_edges(9, 8, 10)
    edges = sorted({*edges, *((f"x{a}", f"x{b}") for a, b in twin), *((f"y{a}", f"y{b}") for a, b in twin)})
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.id: r.community for r in graph.girvan_newman(df).collect()} == brute_split(edges)[1]
    assert graph.components(df).select("component").distinct().count() >= 3


def test_girvan_newman_refuses_and_takes_nothing(spark):
    with pytest.raises(ValueError):
        graph.girvan_newman(toy(spark), most=3)
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.girvan_newman(empty).count() == graph.components(empty).count() == graph.edge_betweenness(empty).count() == graph.edge_betweenness(empty, most=-1).count() == graph.label_propagation(empty).count() == 0


def test_label_propagation_swaps_a_lone_edge(spark):
    df = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert sorted(map(tuple, graph.label_propagation(df, 5).collect())) == [("a", "b"), ("b", "a")]


def test_pearson_and_prediction(spark):
    r = random.Random(5)
    rated = {(f"u{r.randrange(15)}", f"b{r.randrange(12)}"): float(r.randrange(1, 6)) for _ in range(120)}
    ratings = spark.createDataFrame([(u, b, s) for (u, b), s in rated.items()], "user_id string, business_id string, stars double")
    by = defaultdict(dict)
    for (u, b), s in rated.items():
        by[b][u] = s
    want = {}
    for a, b in itertools.combinations(sorted(by), 2):
        both = by[a].keys() & by[b].keys()
        if len(both) >= 3:
            ma, mb = np.mean(list(by[a].values())), np.mean(list(by[b].values()))
            top = sum((by[a][u] - ma) * (by[b][u] - mb) for u in both)
            wide = math.sqrt(sum((by[a][u] - ma) ** 2 for u in both) * sum((by[b][u] - mb) ** 2 for u in both))
            want[a, b] = top / wide if wide > 1e-9 else 0.0
    model = recommend.pearson(ratings, 3)
    assert {(x.b1, x.b2): x.sim for x in model.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    asked = [("u1", "b1"), ("u1", "b1"), ("u2", "b99"), ("nobody", "b1"), ("u3", "b4")]
    sims = {k: round(v, 9) for k, v in want.items()}
    expected = {}
    for u, b in asked:
        mine = {x: s for (v, x), s in rated.items() if v == u}
        near = sorted(((-s, x if y == b else y) for (x, y), s in sims.items() if b in (x, y) and (x if y == b else y) in mine))[:2]
        if not mine:
            expected[u, b] = None
        elif not near:
            expected[u, b] = max(1.0, sum(mine.values()) / len(mine))
        else:
            weight = sum(abs(s) for s, _ in near)
            expected[u, b] = max(1.0, sum(-s * mine[x] for s, x in near) / weight if weight else 1.0)
    got = recommend.predicted(spark.createDataFrame(asked, "user_id string, business_id string"), ratings, model.withColumn("sim", F.round("sim", 9)), 2)
    assert {(x.user_id, x.business_id): x.stars for x in got.collect()} == {k: v if v is None else pytest.approx(v, abs=1e-6) for k, v in expected.items()}


def test_first_rating_blend_and_errors(spark):
    reviews = spark.createDataFrame([("u", "b", 3.0, "2001"), ("u", "b", 1.0, "2000"), ("u", "b", 2.0, "2000"), (None, "b", 1.0, "2000"), ("u", "c", None, "2000")], "user_id string, business_id string, stars double, date string")
    assert [tuple(r) for r in recommend.first_ratings(reviews, ["date"]).collect()] == [("u", "b", 1.0)]
    schema = "user_id string, business_id string, stars double"
    one = spark.createDataFrame([("hi", "b", 4.9), ("lo", "b", 4.0), ("mid", "b", 2.0), ("only", "b", 1.0)], schema)
    two = spark.createDataFrame([("hi", "b", 2.0), ("lo", "b", 3.0), ("mid", "b", 4.0)], schema)
    users = spark.createDataFrame([("hi", 4.2), ("lo", 2.0), ("mid", 3.0)], "user_id string, average_stars double")
    mixed = recommend.blended(one, two, users)
    assert {r.user_id: r.stars for r in mixed.collect()} == {"hi": 5.0, "lo": 3.0, "mid": pytest.approx(3.2)}
    truth = spark.createDataFrame([("hi", "b", 5.0), ("lo", "b", 4.0), ("none", "b", 1.0)], schema)
    e = recommend.errors(mixed, truth).first()
    assert (e.n, e.n_only, e.rmse_only) == (2, 1, 0.0) and e.rmse == pytest.approx(math.sqrt(0.5))


def test_errors_count_pairs_without_a_prediction(spark):
    schema = "user_id string, business_id string, stars double"
    found = spark.createDataFrame([("a", "b", 3.0), ("new", "b", None), ("new", "c", None)], schema)
    e = recommend.errors(found, spark.createDataFrame([("a", "b", 5.0), ("new", "b", 2.0), ("new", "c", 4.0)], schema)).first()
    assert (e.n, e.rmse, e.n_only, e.rmse_only) == (3, 2.0, 2, 2.0)


def test_als_beats_the_worst_guess(spark):
    r = random.Random(2)
    rows = [(f"u{u}", f"b{b}", float(1 + (u + b) % 5)) for u in range(30) for b in range(20) if r.random() < 0.6]
    ratings = spark.createDataFrame(rows, "user_id string, business_id string, stars double")
    got = recommend.als_predicted(ratings.select("user_id", "business_id").unionByName(spark.createDataFrame([("new", "b1")], "user_id string, business_id string")), ratings)
    assert recommend.errors(got, ratings).first().rmse < 0.8
    assert got.where("user_id = 'new'").first().stars is None


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None]], "x string")
    got = {r.x: r.idx for r in similarity.dense_index(df, "x").collect()}
    assert set(got) == {"a", "b", "c"} and sorted(got.values()) == [0, 1, 2]


def test_nmi(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 7) for i in range(30)], "true int, found int")
    assert metrics.nmi(same).first().nmi == pytest.approx(1.0)
    apart = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "true int, found int")
    assert metrics.nmi(apart).first().nmi == pytest.approx(0.0, abs=1e-9)
    assert metrics.nmi(spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "true int, found int")).first().nmi == 1.0
    assert metrics.nmi(same.limit(0)).first().nmi is None


def blobs(spark, seed=1, n=300, d=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 50, (5, d))
    at = rng.integers(0, 5, n)
    x = centre[at] + rng.normal(0, 1, (n, d))
    x[:5] = rng.normal(0, 500, (5, d))
    return spark.createDataFrame([(str(i), v.tolist(), int(a)) for i, (v, a) in enumerate(zip(x, at, strict=True))], "id string, x array<double>, true int")


def test_rounds_keep_every_point_and_find_the_blobs(spark):
    data = blobs(spark)
    state = bfr.clustered(spark, (data.where(F.col("id").cast("int") % 3 == i).select("id", "x") for i in range(3)), 5, 4)
    labels = state.labels()
    assert labels.count() == labels.select("id").distinct().count() == 300
    assert metrics.nmi(labels.join(data, "id").withColumnRenamed("label", "found")).first().nmi > 0.85
    last = state.statistics().collect()[-1]
    assert last.nof_point_discard + last.nof_point_compression + last.nof_point_retained == 300


def test_rounds_of_nothing(spark):
    state = bfr.Rounds(spark, 3, 2)
    state.add(spark.createDataFrame([], "id string, x array<double>"))
    state.add(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 1.0]), ("b", None)], "id string, x array<double>"))
    assert state.labels().count() == 1


def test_merging_summaries(spark):
    near = [(i, 10, [10.0 * c, 0.0], [10 * (c * c + 1.0), 10.0]) for i, c in enumerate((0.0, 0.5, 40.0))]
    rows, renamed = bfr.merge_summaries(near, 3.0)
    assert renamed == {0: 0, 1: 0, 2: 2} and [(r[0], r[1]) for r in rows] == [(0, 20), (2, 10)]


def test_hierarchical_joins_what_is_close(spark):
    rows = [(f"{i}", [float(i // 4) * 100 + i % 4, 0.0]) for i in range(12)]
    got = defaultdict(set)
    for r in bfr.hierarchical(spark.createDataFrame(rows, "id string, x array<double>"), 10.0).collect():
        got[r.label].add(int(r.id) // 4)
    assert sorted(map(sorted, got.values())) == [[0], [1], [2]]


def test_statistics_of_reviews(spark):
    rows = [("u1", "b1", "1998-05-01", "The Cat, the (dog)!"), ("u1", "b2", "1999-01-01", ""), ("u2", "b1", "1998-12-31", None), (None, "b1", None, "cat Cat cat]")]
    df = spark.createDataFrame(rows, "user_id string, business_id string, date string, text string")
    assert tuple(stats.review_summary(df, 1998).first()) == (4, 2, 2)
    stop = spark.createDataFrame([("The",)], "word string")
    assert [tuple(r) for r in stats.top_words(df, 2, stopwords=stop).collect()] == [("cat", 3), ("cat]", 1)]
    assert [tuple(r) for r in stats.top_counts(df, "user_id", 1).collect()] == [("u1", 2)]
    assert tuple(stats.review_summary(df.limit(0), 1998).first()) == (0, 0, 0)
    dealt = stats.dealt_by_first_character(df, "user_id", 4)
    assert [r.n for r in stats.partition_report(dealt, 4).orderBy("part").collect()] == [1, 3, 0, 0]
    assert sorted(map(tuple, stats.having_gt(dealt, "business_id", 2).collect())) == sorted(map(tuple, stats.having_gt(df, "business_id", 2).collect())) == [("b1", 3)]


def test_categories(spark):
    reviews = spark.createDataFrame([("b1", 5.0), ("b1", 3.0), ("b2", 4.0), ("b3", 1.0)], "business_id string, stars double")
    named = spark.createDataFrame([("b1", "Bars, Food"), ("b2", "Bars,, Bars"), ("b3", None)], "business_id string, categories string")
    assert [tuple(r) for r in stats.top_categories(reviews, named, 5).collect()] == [("", 4.0), ("Bars", 4.0), ("Food", 4.0)]


def test_column_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0.0, 3.0], [4.0, 0.0])], "a array<int>, x array<double>, y array<double>")
    row = df.select(C.subsets("a", 3).alias("s"), C.euclidean("x", "y").alias("d"), C.mahalanobis("x", "y", F.array(F.lit(1.0), F.lit(0.0)), 1.0).alias("m")).first()
    assert [tuple(s) for s in row.s] == list(itertools.combinations([1, 2, 3, 4], 3)) and row.d == 5.0 and row.m == pytest.approx(math.sqrt(4 + 9))
    assert C.primes(8) == [2, 3, 5, 7, 11, 13, 17, 19]
    assert df.select(C.clamped(F.lit(None).cast("double"), 1.0, 5.0).alias("c")).first().c is None
