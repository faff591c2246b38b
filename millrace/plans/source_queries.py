"""Queries that write in each layout and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import graph_queries as G
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources import readers, sinks
from millrace.sources.scratch import new_path


def _dated(spark, d):
    return V.reviews(spark, d).select("user_id", "business_id", "stars", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, business_id, stars, strftime(date, '%Y-%m-%d') AS date FROM reviews")
def op_json_lines(spark, d):
    path = new_path(spark)
    sinks.json_lines(_dated(spark, d), path)
    return readers.json_lines(spark, path, readers.REVIEW).select("user_id", "business_id", "stars", "date")


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, business_id, stars, strftime(date, '%Y-%m-%d') AS date FROM reviews WHERE year(date) = 1997")
def op_json_lines_year(spark, d):
    from millrace.functions.columns import in_year

    path = new_path(spark)
    sinks.json_lines(_dated(spark, d), path)
    rows = readers.json_lines(spark, path, readers.REVIEW)
    return rows.where(in_year(rows, "date", 1997)).select("user_id", "business_id", "stars", "date")


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, business_id FROM reviews")
def op_csv_header(spark, d):
    path = new_path(spark)
    sinks.csv(V.reviews(spark, d).select("user_id", "business_id"), path)
    return readers.csv_header(spark, path)


@query(f"{V.with_(V.REVIEWS, V.BUSINESSES)} SELECT user_id, business_id FROM reviews JOIN businesses USING (business_id) WHERE state = 'PROMO' UNION ALL SELECT 'user_id', 'business_id'")
def op_csv_plain(spark, d):
    from millrace.operators.itemsets import prepared

    path = new_path(spark)
    sinks.csv_one_header(prepared(V.reviews(spark, d), V.businesses(spark, d), "PROMO"), path)
    return readers.csv_plain(spark, path)


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, business_id FROM reviews")
def op_csv_without_line(spark, d):
    path = new_path(spark)
    sinks.csv(V.reviews(spark, d).select("user_id", "business_id"), path)
    return readers.csv_without(spark, path, "user_id,business_id")


@query("SELECT DISTINCT w AS word FROM documents, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS t(w) WHERE w <> ''")
def op_word_file(spark, d):
    path = new_path(spark)
    V.table(spark, d, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return readers.word_file(spark, path)


@query(f"{V.with_(V.REVIEWS)} SELECT user_id, business_id, stars FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id, business_id ORDER BY date DESC, okey DESC, line DESC, supp DESC, stars DESC) = 1")
def op_last_duplicate(spark, d):
    return readers.last_by_key(V.reviews(spark, d), ["user_id", "business_id"], "stars", ["date", "okey", "line", "supp", "stars"])


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings")
def op_points_csv(spark, d):
    path = new_path(spark)
    V.points(spark, d).select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(V.DIMS)]).write.csv(path)
    return readers.points(spark, path, V.DIMS).select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS INTEGER) AS label FROM embeddings")
def op_label_document(spark, d):
    path = new_path(spark)
    rows = V.points(spark, d).select("id", F.col("label").cast("int").alias("label"))
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "label")))).alias("value"))
    whole.write.text(path)
    return readers.label_document(spark, path)


@query("SELECT '{\"' || vec_id || '\":' || label || '}' AS line FROM embeddings")
def op_label_lines(spark, d):
    return sinks.label_lines(V.points(spark, d))


@query(f"{G.BASE}, {G.PATHS} SELECT '(''' || src || ''', ''' || dst || '''), ' || CAST(round(betweenness, 6) AS VARCHAR) AS line FROM betweenness")
def op_betweenness_lines(spark, d):
    found = graph.edge_betweenness(G.edges(spark, d)).withColumn("betweenness", F.round("betweenness", 6))
    path = new_path(spark)
    sinks.text_lines(sinks.betweenness_lines(found), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
