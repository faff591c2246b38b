"""Queries over all groups and all points against plain Python."""

import itertools
from collections import Counter

from millrace.operators import bfr
from millrace.plans import catalogue, cluster_queries, itemset_queries
from millrace.plans import views as V

SF = "/root/testdata/sf0.001"


def grouped(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, set()).add(v)
    return out


def test_pairs_of_every_business(spark):
    groups = grouped((r.business_id, r.user_id) for r in V.visits(spark, SF).collect())
    want = sorted((k, a, b) for k, v in groups.items() for a, b in itertools.combinations(sorted(v), 2))
    assert sorted(tuple(r) for r in catalogue.QUERIES["op_self_join_pairs"](spark, SF).select("business_id", "a", "b").collect()) == want


def test_triples_of_every_basket(spark):
    groups = grouped((r.basket, r.item) for r in V.order_baskets(spark, SF).collect())
    want = sorted((k, ",".join(s)) for k, v in groups.items() for s in itertools.combinations(sorted(v), 3))
    assert sorted((r.basket, r["items"]) for r in catalogue.QUERIES["op_combinations"](spark, SF).collect()) == want
    assert max(map(len, groups.values())) > 4


def test_residual_points_are_all_outside_the_discard_sets(spark):
    points = V.points(spark, SF).select("id", "x")
    state = bfr.Rounds(spark, cluster_queries.K, cluster_queries.DIMS)
    state.add(points)
    held = {r.id for m in state.ds_members for r in m.collect()}
    rows = catalogue.QUERIES["op_bfr_residual"](spark, SF).collect()
    assert sorted(r.id for r in rows) == sorted({r.id for r in points.collect()} - held) and held
    sizes = grouped((r.label, r.id) for r in rows)
    assert all((r.kind == "RS") == (len(sizes[r.label]) == 1) for r in rows)


def test_retained_points_are_those_of_the_rounds(spark):
    retained = cluster_queries._rounds(spark, SF).rs.count()
    rows = catalogue.QUERIES["op_bfr_recluster_rs"](spark, SF).collect()
    assert sum(r.n for r in rows) == retained > 1 and len(rows) <= min(5 * cluster_queries.K, retained)


def test_two_passes_find_sets_beyond_pairs(spark):
    groups = grouped((r.basket, r.item) for r in V.order_baskets(spark, SF).collect())
    counts = Counter(s for v in groups.values() for n in range(1, 7) for s in itertools.combinations(sorted(v), n))
    want = {",".join(s): n for s, n in counts.items() if n >= itemset_queries.SUPPORT}
    assert {r["items"]: r.n for r in catalogue.QUERIES["op_son_pass2"](spark, SF).collect()} == want
    assert any(k.count(",") > 1 for k in want)
