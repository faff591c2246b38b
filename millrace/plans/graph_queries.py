"""Queries over the graph of users who share businesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources import sinks
from millrace.sources.scratch import written

LEAST, TIGHT, ROUNDS, DEEPEST = 7, 8, 5, 60
EDGES = f"""edges AS (
  SELECT x.user_id AS src, y.user_id AS dst, count(*) AS n FROM visits x JOIN visits y ON x.business_id = y.business_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
tight AS (SELECT src, dst FROM edges WHERE n >= {TIGHT})"""
BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), vertices AS (SELECT DISTINCT src AS id FROM both_ways)"
BASE = V.with_(V.REVIEWS, V.VISITS, EDGES, BOTH)
LABELS = "l0 AS (SELECT id, id AS community FROM vertices), " + ", ".join(
    f"""l{k + 1} AS (SELECT id, community FROM (
  SELECT src AS id, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS r FROM both_ways JOIN l{k} ON l{k}.id = dst GROUP BY src, community) WHERE r = 1)"""
    for k in range(ROUNDS)
)
REACH = "reach(id, other) AS (SELECT id, id FROM vertices UNION SELECT reach.id, dst FROM reach JOIN both_ways ON src = other), comps AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"
PATHS = f"""walks(source, id, level) AS (SELECT id, id, 0 FROM vertices UNION SELECT source, dst, level + 1 FROM walks JOIN both_ways ON src = id WHERE level < {DEEPEST}),
levels AS (SELECT source, id, min(level) AS level FROM walks GROUP BY 1, 2),
steps AS (SELECT a.source, a.id, b.id AS child, a.level FROM levels a JOIN both_ways ON src = a.id JOIN levels b ON b.source = a.source AND b.id = dst AND b.level = a.level + 1),
paths(source, id, level, paths) AS (SELECT id, id, 0, 1.0::DOUBLE FROM vertices UNION ALL SELECT paths.source, child, paths.level + 1, sum(paths) FROM paths JOIN steps ON steps.source = paths.source AND steps.id = paths.id GROUP BY 1, 2, 3),
betweenness AS (
  SELECT e.src, e.dst, sum(up.paths * down.paths / whole.paths) AS betweenness
  FROM edges e JOIN paths up ON up.id IN (e.src, e.dst)
  JOIN paths down ON down.id = (CASE WHEN up.id = e.src THEN e.dst ELSE e.src END)
  JOIN paths whole ON whole.source = up.source AND whole.id = down.source AND whole.level = up.level + 1 + down.level
  WHERE up.id = e.src GROUP BY 1, 2)"""


def edges(spark, d, least=LEAST):
    """The edges as a table of their own: most graph operators read them several times."""
    return written(graph.cooccurrence_edges(written(V.visits(spark, d)), "user_id", "business_id", least))


@query(f"{BASE} SELECT src, dst, n FROM edges")
def op_cooccurrence_edges(spark, d):
    return edges(spark, d)


@query(f"{BASE} SELECT id FROM vertices")
def op_vertices(spark, d):
    return graph.vertices(edges(spark, d))


@query(f"{BASE} SELECT src, dst FROM both_ways")
def op_symmetric_edges(spark, d):
    return graph.symmetric(edges(spark, d))


@query(f"{BASE} SELECT DISTINCT user_id AS id FROM reviews WHERE user_id NOT IN (SELECT id FROM vertices)")
def op_isolated_vertices(spark, d):
    return graph.isolated(V.reviews(spark, d).select(F.col("user_id").alias("id")).distinct(), edges(spark, d))


@query(f"{BASE} SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY 1")
def op_degree(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"{BASE}, {LABELS} SELECT id, community FROM l{ROUNDS}")
def op_label_propagation(spark, d):
    return graph.label_propagation(edges(spark, d), ROUNDS)


@query(f"{BASE}, {LABELS} SELECT community, count(*) AS n FROM l{ROUNDS} GROUP BY 1")
def op_group_sizes(spark, d):
    return graph.community_sizes(graph.label_propagation(edges(spark, d), ROUNDS))


@query(f"{BASE}, {LABELS}, lines AS (SELECT string_agg('''' || id || '''', ', ' ORDER BY id) AS line FROM l{ROUNDS} GROUP BY community) SELECT length(line) AS length, line FROM lines ORDER BY 1, 2")
def op_community_order(spark, d):
    return sinks.community_lines(graph.label_propagation(edges(spark, d), ROUNDS)).withColumn("length", F.col("length").cast("bigint")).orderBy("length", "line")


@query(f"{BASE}, {REACH} SELECT id, component FROM comps")
def op_connected_components(spark, d):
    return graph.components(edges(spark, d))


@query(f"{BASE}, {PATHS} SELECT source, id, CAST(level AS BIGINT) AS level FROM levels")
def op_bfs_levels(spark, d):
    return graph.shortest_paths(edges(spark, d)).select("source", "id", "level")


@query(f"{BASE}, {PATHS} SELECT source, id, CAST(level AS BIGINT) AS level, paths FROM paths")
def op_shortest_path_count(spark, d):
    return graph.shortest_paths(edges(spark, d))


@query(f"{BASE}, {PATHS} SELECT src, dst, round(betweenness, 6) AS betweenness FROM betweenness")
def op_edge_betweenness(spark, d):
    return graph.edge_betweenness(edges(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query(f"{BASE}, {PATHS} SELECT src, dst, round(betweenness, 6) AS betweenness FROM betweenness")
def op_edge_betweenness_joins(spark, d):
    return graph.edge_betweenness(edges(spark, d), most=0).withColumn("betweenness", F.round("betweenness", 6))


@query(f"{BASE}, {PATHS} SELECT src, dst, round(betweenness, 6) AS betweenness FROM betweenness ORDER BY round(betweenness, 9) DESC, src, dst LIMIT 20")
def op_betweenness_order(spark, d):
    found = graph.edge_betweenness(edges(spark, d))
    return found.orderBy(F.desc(F.round("betweenness", 9)), "src", "dst").limit(20).withColumn("betweenness", F.round("betweenness", 6))


@query(f"{BASE}, {PATHS} SELECT src, dst FROM edges EXCEPT (SELECT src, dst FROM betweenness ORDER BY round(betweenness, 9) DESC, src, dst LIMIT 1)")
def op_remove_edge(spark, d):
    found = graph.edge_betweenness(edges(spark, d))
    return found.select("src", "dst").join(F.broadcast(graph.heaviest_edge(found).select("src", "dst")), ["src", "dst"], "left_anti")


_TIGHT = """near AS (SELECT src, dst FROM tight UNION SELECT dst, src FROM tight),
reach(id, other) AS (SELECT id, id FROM vertices UNION SELECT reach.id, dst FROM reach JOIN near ON src = other), parts AS (SELECT id, min(other) AS community FROM reach GROUP BY 1)"""


@query(
    f"""{BASE}, {_TIGHT},
inside AS (SELECT a.community, count(*) AS k FROM edges JOIN parts a ON a.id = src JOIN parts b ON b.id = dst WHERE a.community = b.community GROUP BY 1),
deg AS (SELECT community, count(*) AS k FROM near JOIN parts ON id = src GROUP BY 1), m AS (SELECT count(*) AS m FROM edges)
SELECT round((SELECT sum(k) FROM inside) / m - (SELECT sum(k * k) FROM deg) / (4.0 * m * m), 6) AS q FROM m"""
)
def op_modularity(spark, d):
    whole = edges(spark, d)
    reduced = whole.where(F.col("n") >= TIGHT)
    communities = graph.components(reduced, graph.vertices(whole)).withColumnRenamed("component", "community")
    return graph.modularity(communities, whole, reduced).select(F.round("q", 6).alias("q"))


@query()
def op_girvan_newman(spark, d):
    return graph.girvan_newman(edges(spark, d, TIGHT), V.reviews(spark, d).select(F.col("user_id").alias("id")).distinct())
