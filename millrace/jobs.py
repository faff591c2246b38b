"""Whole jobs: files in, files out. `python -m millrace JOB --help` lists the parameters of each."""

from __future__ import annotations

import argparse
import inspect
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bfr, graph, itemsets, metrics, recommend, similarity, stats
from millrace.sources import readers, sinks
from millrace.sources.scratch import written

#: A document is one JSON value that the driver writes; longer lists are refused and belong in the line-wise outputs.
MOST_LISTED = 1_000_000
RATED = ["date", "stars"]


def listed(df: DataFrame, most: int = MOST_LISTED) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one document")
    return rows


def review_stats(spark: SparkSession, input: str, output: str, stopwords: str, y: int = 2018, m: int = 10, n: int = 10) -> None:
    """Reviews in all, in year y, distinct users, the m most active users, the n most frequent words."""
    reviews = readers.json_lines(spark, input, readers.REVIEW)
    s = stats.review_summary(reviews, y).first()
    users = [[r["user_id"], r["n"]] for r in stats.top_counts(reviews, "user_id", m).collect()]
    words = [r["word"] for r in stats.top_words(reviews, n, stopwords=readers.word_file(spark, stopwords)).collect()]
    sinks.document(spark, {"A": s["n_reviews"], "B": s["n_year"], "C": s["n_users"], "D": users, "E": words}, output)


def top_categories(spark: SparkSession, reviews: str, businesses: str, output: str, n: int = 10) -> None:
    """The n categories of the best mean stars."""
    found = stats.top_categories(readers.json_lines(spark, reviews, readers.REVIEW), readers.json_lines(spark, businesses, readers.BUSINESS), n)
    sinks.document(spark, {"result": [[r["category"], r["mean"]] for r in found.collect()]}, output)


def busy_businesses(spark: SparkSession, input: str, output: str, n: int = 10, partitions: int = 0) -> None:
    """Businesses of more than n reviews, and how the reviews are dealt; partitions: by first character over so many, 0: as they are read."""
    reviews = readers.json_lines(spark, input, readers.REVIEW).select("business_id")
    dealt = stats.dealt_by_first_character(reviews, "business_id", partitions) if partitions else reviews
    parts = partitions or reviews.rdd.getNumPartitions()
    sizes = [r["n"] for r in listed(stats.partition_report(dealt, parts).orderBy("part"))]
    found = [[r["business_id"], r["n"]] for r in listed(stats.having_gt(dealt, "business_id", n).orderBy(F.desc("n"), "business_id"))]
    sinks.document(spark, {"n_partitions": parts, "n_items": sizes, "result": found}, output)


def frequent_itemsets(spark: SparkSession, input: str, output: str, c: int = 1, s: int = 10, most: int = 6, k: int = -1, parts: int = 2, header: bool = True) -> None:
    """Itemsets of support s: c=1 of businesses by user, c=2 of users by business. k: only baskets of more rows than that (-1: all)."""
    if c not in (1, 2):
        raise ValueError("case is 1 or 2")
    began = time.time()
    pairs = readers.csv_header(spark, input) if header else readers.csv_plain(spark, input)
    basket, item = ("user_id", "business_id") if c == 1 else ("business_id", "user_id")
    rows = written(itemsets.basket_rows(pairs, basket, item, None if k < 0 else k))
    sets = written(itemsets.local_candidates(rows, s, parts, most))
    order = [F.size("items"), "items"]
    candidates = [r["items"] for r in listed(sets.orderBy(*order))]
    frequent = [r["items"] for r in listed(itemsets.counted_candidates(rows, sets, s).orderBy(*order))]
    sinks.document(spark, {"Candidates": candidates, "Frequent Itemsets": frequent, "Runtime": time.time() - began}, output)


def prepare_baskets(spark: SparkSession, reviews: str, businesses: str, output: str, state: str = "NV") -> None:
    """(user_id, business_id) of the reviews of businesses in a state, as CSV."""
    sinks.csv(itemsets.prepared(readers.json_lines(spark, reviews, readers.REVIEW), readers.json_lines(spark, businesses, readers.BUSINESS), state), output)


def similar_businesses(spark: SparkSession, input: str, output: str, threshold: float = 0.1, bands: int = 50, rows: int = 4, exact: bool = False) -> None:
    """Businesses whose sets of users are alike, as model lines."""
    pairs = readers.json_lines(spark, input, readers.REVIEW).select("business_id", "user_id").dropna().distinct()
    found = similarity.jaccard_pairs(pairs, "business_id", "user_id", threshold) if exact else similarity.lsh_jaccard_pairs(pairs, "business_id", "user_id", threshold, bands, rows, seed=1)
    sinks.json_lines(found.toDF("b1", "b2", "sim"), output)


def build_model(spark: SparkSession, input: str, output: str, m: int = 3) -> None:
    """Correlations of businesses that m or more users rated both, as model lines."""
    ratings = recommend.first_ratings(readers.json_lines(spark, input, readers.REVIEW), RATED)
    sinks.json_lines(recommend.pearson(ratings, m, digits=2), output)


def predict(spark: SparkSession, train: str, test: str, model: str, output: str, n: int = 3) -> None:
    """Ratings from the n nearest rated neighbours, as prediction lines."""
    ratings = recommend.first_ratings(readers.json_lines(spark, train, readers.REVIEW), RATED)
    sinks.json_lines(recommend.predicted(readers.json_lines(spark, test, readers.PAIR), ratings, readers.json_lines(spark, model, readers.MODEL), n), output)


def als(spark: SparkSession, train: str, test: str, output: str, rank: int = 4, iterations: int = 11, ridge: float = 0.07, seed: int = 1) -> None:
    """Ratings from matrix factorisation, as prediction lines."""
    ratings = recommend.first_ratings(readers.json_lines(spark, train, readers.REVIEW), RATED)
    sinks.json_lines(recommend.als_predicted(readers.json_lines(spark, test, readers.PAIR), ratings, rank, iterations, ridge, seed), output)


def blend(spark: SparkSession, first: str, second: str, users: str, output: str) -> None:
    """Two predictions blended by how generous each user is, as prediction lines."""
    read = lambda p: readers.json_lines(spark, p, readers.RATING)
    sinks.json_lines(recommend.blended(read(first), read(second), readers.json_lines(spark, users, readers.USER)), output)


def evaluate(spark: SparkSession, predictions: str, truth: str, output: str) -> None:
    """Root mean square errors, over all pairs and over true ratings of 1, 2 and 5."""
    r = recommend.errors(readers.json_lines(spark, predictions, readers.RATING), readers.json_lines(spark, truth, readers.RATING)).first()
    sinks.document(spark, r.asDict(), output)


def _user_edges(spark: SparkSession, input: str, t: int) -> DataFrame:
    return written(graph.cooccurrence_edges(readers.csv_header(spark, input).dropna(), "user_id", "business_id", t))


def propagate(spark: SparkSession, input: str, output: str, t: int = 7, rounds: int = 5) -> None:
    """Communities of users who share t or more businesses, by label propagation, as text lines."""
    sinks.text_lines(sinks.community_lines(graph.label_propagation(_user_edges(spark, input, t), rounds)), output)


def split_communities(spark: SparkSession, input: str, output: str, betweenness: str, t: int = 7) -> None:
    """Edge betweenness, and the communities of best modularity as heavy edges are taken out, as text lines."""
    edges = _user_edges(spark, input, t)
    sinks.text_lines(sinks.betweenness_lines(graph.edge_betweenness(edges)), betweenness)
    sinks.text_lines(sinks.community_lines(graph.girvan_newman(edges)), output)


def cluster(spark: SparkSession, input: str, labels: str, statistics: str, dims: int, k: int = 10, seed: int = 1) -> None:
    """Chunked clustering of a folder of point files: label lines, and statistics of each round as CSV."""
    chunks = (readers.points(spark, p, dims) for p in readers.chunk_paths(spark, input))
    state = bfr.clustered(spark, chunks, k, dims, seed)
    sinks.text_lines(sinks.label_lines(state.labels()), labels)
    sinks.csv(state.statistics().coalesce(1), statistics)


def agreement(spark: SparkSession, truth: str, found: str, output: str) -> None:
    """Normalised mutual information of two label documents."""
    both = readers.label_document(spark, truth).withColumnRenamed("label", "true").join(readers.label_document(spark, found).withColumnRenamed("label", "found"), "id")
    sinks.document(spark, {"nmi": metrics.nmi(both).first()["nmi"]}, output)


JOBS = {f.__name__: f for f in (review_stats, top_categories, busy_businesses, frequent_itemsets, prepare_baskets, similar_businesses, build_model, predict, als, blend, evaluate, propagate, split_communities, cluster, agreement)}
KINDS = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("1", "true", "yes")}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        one = commands.add_parser(name, help=job.__doc__, description=job.__doc__)
        for p in list(inspect.signature(job).parameters.values())[1:]:
            required = p.default is inspect.Parameter.empty
            one.add_argument(f"--{p.name}", type=KINDS[p.annotation], required=required, default=None if required else p.default)
    told = vars(parser.parse_args(args))
    spark = SparkSession.builder.appName(f"millrace {told['job']}").getOrCreate()
    JOBS[told.pop("job")](spark, **told)
