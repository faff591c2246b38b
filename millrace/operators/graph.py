"""Graphs as edge tables (src < dst): co-occurrence, label propagation, components, shortest paths, betweenness, modularity, community splitting."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.pairs import shared_keys
from millrace.sources.scratch import written

#: Edges up to this number are broadcast as arrays for the per-source search (some 30 MB for numbers as ids); larger graphs go level by level in joins.
BROADCAST_EDGES = 500_000
#: Girvan-Newman takes out one edge after the other, and the driver puts the components' removals in order: graphs of more edges than this are refused.
MOST_SPLIT_EDGES = 200_000


def cooccurrence_edges(rows: DataFrame, entity: str, key: str, least: int) -> DataFrame:
    """(src, dst, n): entities with `least` or more distinct keys in common."""
    return shared_keys(rows.select(entity, key).distinct(), entity, key, least).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with src < dst; loops and nulls are left out."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, distinct."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def isolated(all_vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the vertices without an edge."""
    return all_vertices.join(vertices(edges), "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): in each round, all vertices at once take the most frequent label among their neighbours (of ties, the smallest). Labels start as ids."""
    both = written(symmetric(edges))
    labels = vertices(edges).withColumn("community", F.col("id"))
    for _ in range(rounds):
        counts = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        labels = written(counts.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    return labels


def components(edges: DataFrame, all_vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that each vertex reaches. Min-label rounds with pointer jumping; vertices without edges are their own."""
    both = written(symmetric(edges))
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near")).select("id", F.least("id", "near").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = written(lower.join(roots, "component").select("id", F.least("component", "root").alias("component"), (F.least("component", "root") < F.col("was")).alias("moved")))
    out = labels.select("id", "component")
    return out if all_vertices is None else out.unionByName(isolated(all_vertices, edges).select("id", F.col("id").alias("component")))


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, level, paths): distance from each source (all vertices, or the ids given) and the number of shortest paths. One join round for each level."""
    both = written(symmetric(edges))
    start = (vertices(edges) if sources is None else sources.select("id").distinct()).select(F.col("id").alias("source"), "id")
    front = written(start.select("source", "id", F.lit(0).cast("bigint").alias("level"), F.lit(1.0).alias("paths")))
    seen, parts = front.select("source", "id"), [front]
    while True:
        step = front.join(both, front["id"] == both["src"]).groupBy("source", F.col("dst").alias("id"), (F.col("level") + 1).alias("level")).agg(F.sum("paths").alias("paths"))
        front = written(step.join(seen, ["source", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        parts.append(front)
        seen = written(seen.unionByName(front.select("source", "id"))) if len(parts) % 8 == 0 else seen.unionByName(front.select("source", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _credits(near: dict, source) -> dict:
    """Brandes: what the shortest paths from one source add to each edge."""
    level, paths, order, before = {source: 0}, {source: 1.0}, [], defaultdict(list)
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in level:
                level[w], paths[w] = level[v] + 1, 0.0
                queue.append(w)
            if level[w] == level[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    credit, out = dict.fromkeys(order, 1.0), {}
    for w in reversed(order):
        for v in before[w]:
            share = credit[w] * paths[v] / paths[w]
            credit[v] += share
            out[(v, w) if v < w else (w, v)] = share
    return out


def _adjacency(pairs: list[tuple]) -> dict:
    near: dict = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    return near


class _Arrays:
    """An undirected graph as arrays: neighbours (and the numbers of the edges to them) of all vertices in a row, and where each vertex's begin."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
        self.src, self.dst = code[: len(src)].astype(np.int32), code[len(src) :].astype(np.int32)
        ends = np.concatenate([self.src, self.dst])
        order = np.argsort(ends, kind="stable")
        self.near = np.concatenate([self.dst, self.src])[order]
        self.edge = (order % len(src)).astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(self.ids)))])

    def add_credits(self, source: int, total: np.ndarray) -> None:
        """Brandes, level by level: adds to each edge what the shortest paths from one source give it."""
        level, paths, credit = np.full(len(self.ids), -1, np.int32), np.zeros(len(self.ids)), np.ones(len(self.ids))
        level[source], paths[source] = 0, 1.0
        front, steps = np.array([source]), []
        while len(front):
            size = self.begin[front + 1] - self.begin[front]
            at = np.repeat(self.begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            above, below = np.repeat(front, size), self.near[at]
            level[below[level[below] < 0]] = len(steps) + 1
            down = level[below] == len(steps) + 1
            above, below, edge = above[down], below[down], self.edge[at[down]]
            np.add.at(paths, below, paths[above])
            steps.append((above, below, edge))
            front = np.unique(below)
        for above, below, edge in reversed(steps):
            share = credit[below] * paths[above] / paths[below]
            np.add.at(credit, above, share)
            total[edge] += share


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None, halved: bool = True, most: int = BROADCAST_EDGES) -> DataFrame:
    """(src, dst, betweenness): the number of shortest paths through each edge, each pair of ends counted once (twice if not halved), shared out where there are several.

    A graph of up to `most` edges is broadcast as arrays and searched source by source; a larger one goes level by level. Edges are taken as undirected and distinct.
    """
    plain = written(simple_edges(edges))
    scale = 0.5 if halved else 1.0
    starts = vertices(plain) if sources is None else sources.select("id").distinct()
    if plain.count() <= most:
        held = plain.toArrow()
        shared = plain.sparkSession.sparkContext.broadcast(_Arrays(*(held[c].to_numpy() for c in ("src", "dst"))))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            arrays = shared.value
            known, total = pd.Index(arrays.ids), np.zeros(len(arrays.src))
            for batch in batches:
                for source in known.get_indexer(batch["id"]):
                    if source >= 0:
                        arrays.add_credits(source, total)
            if len(used := np.flatnonzero(total)):
                yield pd.DataFrame({"src": arrays.ids[arrays.src[used]], "dst": arrays.ids[arrays.dst[used]], "betweenness": total[used]})

        kind = dict(plain.dtypes)["src"]
        parts = starts.repartition(starts.sparkSession.sparkContext.defaultParallelism, "id").mapInPandas(search, f"src {kind}, dst {kind}, betweenness double")
        return parts.groupBy("src", "dst").agg((F.sum("betweenness") * scale).alias("betweenness"))
    found = written(shortest_paths(plain, starts))
    down = symmetric(plain).select(F.col("src").alias("id"), F.col("dst").alias("child"))
    deep = found.select("source", F.col("id").alias("child"), (F.col("level") - 1).alias("level"), F.col("paths").alias("child_paths"))
    links = written(found.join(down, "id").join(deep, ["source", "child", "level"]).select("source", "id", "child", "level", (F.col("paths") / F.col("child_paths")).alias("share")))
    credit, parts = None, []
    for level in range(found.agg(F.max("level")).first()[0] or 0, 0, -1):
        at = links.where(F.col("level") == level - 1)
        here = at.withColumn("credit", F.lit(1.0)) if credit is None else at.join(credit.withColumnRenamed("id", "child"), ["source", "child"], "left").withColumn("credit", 1.0 + F.coalesce("sum", F.lit(0.0)))
        parts.append(written(here.select("source", "id", "child", (F.col("share") * F.col("credit")).alias("credit"))))
        credit = parts[-1].groupBy("source", "id").agg(F.sum("credit").alias("sum"))
    if not parts:
        return plain.withColumn("betweenness", F.lit(0.0)).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.least("id", "child").alias("src"), F.greatest("id", "child").alias("dst")).agg((F.sum("credit") * scale).alias("betweenness"))


def heaviest_edge(betweenness: DataFrame) -> DataFrame:
    """The edge of the largest betweenness; of ties (to nine places), the first by its ends."""
    return betweenness.orderBy(F.desc(F.round("betweenness", 9)), "src", "dst").limit(1)


def modularity(communities: DataFrame, edges: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row (q): sum over communities of inner edges / m - (sum of degrees / 2m)^2. Edges and m are those of `edges`; degrees those of `current`, a graph that has lost edges (`edges` itself gives the textbook value)."""
    plain, at = simple_edges(edges), communities.select("id", "community")
    inner = plain.join(at.select(F.col("id").alias("src"), F.col("community").alias("c")), "src").join(at.select(F.col("id").alias("dst"), F.col("community").alias("d")), "dst").where("c = d").groupBy(F.col("c").alias("community")).agg(F.count("*").alias("inner"))
    degree = degrees(plain if current is None else simple_edges(current)).join(at, "id").groupBy("community").agg(F.sum("degree").alias("degree"))
    parts = at.select("community").distinct().join(inner, "community", "left").join(degree, "community", "left").select(F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("degree", F.lit(0)).alias("degree"))
    sums = parts.agg(F.sum("inner").alias("inner"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"))
    return sums.crossJoin(F.broadcast(plain.agg(F.count("*").alias("m")))).select((F.col("inner") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("q"))


class _Split:
    """A component of a graph of m edges that loses its heaviest edge again and again. Only the part that lost an edge is searched anew."""

    def __init__(self, pairs: list[tuple], m: int):
        self.m = m
        self.near = {v: set(n) for v, n in _adjacency(pairs).items()}
        self.whole = {v: frozenset(n) for v, n in self.near.items()}
        self.part: dict = {}
        self.members: dict = {}
        self.heaviest: dict = {}
        self.inner: dict = {}
        todo = set(self.near)
        while todo:
            found = self._reach(min(todo))
            self._put(found)
            todo -= found

    def _reach(self, start) -> set:
        seen, stack = {start}, [start]
        while stack:
            for w in self.near[stack.pop()]:
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        return seen

    def _put(self, found: set) -> None:
        name = min(found)
        self.members[name] = found
        self.part.update(dict.fromkeys(found, name))
        total: dict = defaultdict(float)
        near = {v: sorted(self.near[v]) for v in found}
        for v in found:
            for edge, x in _credits(near, v).items():
                total[edge] += x / 2
        if total:
            self.heaviest[name] = min((-round(x, 9), e) for e, x in total.items())
        self.inner[name] = sum(len(self.whole[v] & found) for v in found) // 2

    def q(self) -> float:
        """The component's share of the modularity."""
        return sum(self.inner[n] / self.m - (sum(len(self.near[v]) for v in found) / (2 * self.m)) ** 2 for n, found in self.members.items())

    def next(self) -> tuple | None:
        """(minus betweenness, edge) of what is taken out next."""
        return min(self.heaviest.values(), default=None)

    def cut(self) -> None:
        a, b = self.next()[1]
        self.near[a].discard(b)
        self.near[b].discard(a)
        name = self.part[a]
        for table in (self.members, self.heaviest, self.inner):
            del table[name]
        found = self._reach(a)
        self._put(found)
        if b not in found:
            self._put(self._reach(b))


def _best_moment(removals: dict) -> dict:
    """How many edges each component has lost when the modularity of the whole graph is largest for the first time; removals: for each component (minus betweenness, src, dst, share of q) by step."""
    at = dict.fromkeys(removals, 0)
    heads = [(*steps[0][:3], c) for c, steps in removals.items() if steps[0][0] is not None]
    heapify(heads)
    q = sum(steps[0][3] for steps in removals.values())
    best, found = q, dict(at)
    lost = []  # components since the best moment
    while heads:
        c = heappop(heads)[3]
        q += removals[c][at[c] + 1][3] - removals[c][at[c]][3]
        at[c] += 1
        lost.append(c)
        if q > best + 1e-12:
            best = q
            for x in lost:
                found[x] += 1
            lost = []
        value, src, dst, _ = removals[c][at[c]]
        if value is not None:
            heappush(heads, (value, src, dst, c))
    return found


def girvan_newman(edges: DataFrame, all_vertices: DataFrame | None = None, most: int = MOST_SPLIT_EDGES) -> DataFrame:
    """(id, community): of all graphs that arise as the heaviest edge is taken out again and again, the components of the first one with the largest
    modularity (edges of the whole graph, degrees of the reduced one). A community is named by its smallest member; vertices without edges are their own.

    What a component loses, and in which order, does not depend on the others, so components are split in parallel; the driver only puts their removals
    in order, one row for each edge, and each component is then split again as far as the best moment. The graph is counted first and has to have at
    most `most` edges; ValueError otherwise.
    """
    plain = written(simple_edges(edges))
    n = plain.count()
    if n > most:
        raise ValueError(f"{n} edges; at most {most} can be split one by one (raise `most`, or use label_propagation)")
    kind = dict(plain.dtypes)["src"]
    part = plain.join(components(plain).select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst")

    def pairs(pdf: pd.DataFrame) -> list[tuple]:
        return sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))

    def lose(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, rows = _Split(pairs(pdf), n), []
        while True:
            head = graph.next()
            rows.append((pdf["component"].iloc[0], len(rows), *((head[0], *head[1]) if head else (None, None, None)), graph.q()))
            if not head:
                return pd.DataFrame(rows, columns=["component", "step", "value", "src", "dst", "q"])
            graph.cut()

    removals: dict = defaultdict(list)
    for r in part.groupBy("component").applyInPandas(lose, f"component {kind}, step bigint, value double, src {kind}, dst {kind}, q double").orderBy("component", "step").toLocalIterator():
        removals[r.component].append((r.value, r.src, r.dst, r.q))
    moments = plain.sparkSession.createDataFrame(list(_best_moment(removals).items()), f"component {kind}, lost bigint")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = _Split(pairs(pdf), n)
        for _ in range(int(pdf["lost"].iloc[0])):
            graph.cut()
        return pd.DataFrame({"id": list(graph.part), "community": list(graph.part.values())})

    out = part.join(F.broadcast(moments), "component").groupBy("component").applyInPandas(split, f"id {kind}, community {kind}")
    return out if all_vertices is None else out.unionByName(isolated(all_vertices, plain).select("id", F.col("id").alias("community")))


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community")


