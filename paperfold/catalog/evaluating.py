"""The evaluation jobs as queries: search evaluation, calibration, planner comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.registry import query
from paperfold.catalog.retrieval import RANKED_SQL
from paperfold.functions.providers import hashing_embedder, lexical_overlap
from paperfold.plans import evaluation as E
from paperfold.plans import search as S

LIMIT = 15


def searcher(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """Searches over all documents, embedded by the default embedder."""
    embed, vectors, stored = hashing_embedder(64), b.text_vectors(spark, sf_dir), b.stored_chunks(spark, sf_dir)
    limits = None if threshold is None else spark.createDataFrame([("corpus", None, threshold)], "name string, vector_min_score double, rerank_min_score double")

    def search(queries: DataFrame) -> DataFrame:
        return S.search(queries.withColumn("vector", embed("query")), vectors, stored, limits, lexical_overlap)

    return search


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per benchmark text; expected are a document and a topic out of all."""
    k = F.col("item_id")
    n = b.table(spark, sf_dir, "documents").count()
    topics = b.table(spark, sf_dir, "embeddings").select("label").distinct().count()
    return b.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), k).alias("case_id"), F.col("text").alias("query"), b.corpus_of("item_id"), b.no_filters().alias("filters"),
        F.array(F.concat(F.lit("d"), k * 37 % n)).alias("any_chunk_ids"), F.array(F.concat(F.lit("t"), k % topics)).alias("any_topics"),
        F.when(k % 3 == 0, 2).otherwise(10).alias("top_k"))


VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(E.DEFAULT_NEGATIVES))
PLANNED = "CASE WHEN item_id % 4 = 3 THEN text ELSE substr(text, 1, 60) END"
ASKED_SQL = f"""asked AS (SELECT item_id, text FROM benchmark
  UNION ALL SELECT 1000000 + i, q FROM (VALUES {VALUES}) v(i, q) UNION ALL SELECT 2000000 + item_id, {PLANNED} FROM benchmark),
cases AS (SELECT item_id, 'q' || item_id AS case_id, 'd' || (item_id * 37 % (SELECT count(*) FROM documents)) AS want,
  't' || (item_id % (SELECT count(DISTINCT label) FROM embeddings)) AS topic, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 10 END AS top_k FROM benchmark)"""
MATCHED_SQL = """matched AS (SELECT c.case_id, any_value(c.top_k) AS top_k, min(r.rank) AS matched_rank, arg_min(r.score, r.rank) AS matched_score
  FROM cases c LEFT JOIN results r ON r.query_id = c.case_id AND (r.chunk_id = c.want OR r.topic = c.topic) GROUP BY c.case_id)"""


def asked_sql(then: str, body: str, threshold: bool) -> str:
    ranked = RANKED_SQL if threshold else RANKED_SQL.replace("WHERE score >= 0.25", "")
    parts = [ASKED_SQL, b.CTE["ch"], b.CTE["tok"].replace("FROM benchmark", "FROM asked"), ranked, then]
    return "WITH RECURSIVE " + ",\n".join(p for p in parts if p) + "\n" + body


@query("evaluation_job", asked_sql(MATCHED_SQL, """
SELECT case_id, matched_rank, round(matched_score, 6) AS matched_score, coalesce(matched_rank <= top_k, FALSE) AS passed FROM matched""", True))
def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case searched and matched; cases without a result have a row too."""
    matched = E.evaluate(cases(spark, sf_dir), searcher(spark, sf_dir, 0.25), LIMIT, True)
    return matched.select("case_id", "matched_rank", F.round("matched_score", 6).alias("matched_score"), "passed")


@query("calibration_job", asked_sql(MATCHED_SQL, """
SELECT round(w, 6) AS weakest_positive_score, round(s, 6) AS strongest_negative_score, coalesce(s < w, FALSE) AS has_clean_gap,
  CASE WHEN s < w THEN round(s + (w - s) / 2, 4) END AS suggested_rerank_min_score
FROM (SELECT (SELECT min(matched_score) FROM matched WHERE matched_rank <= top_k) AS w,
  (SELECT max(top) FROM (SELECT arg_min(score, rank) AS top FROM results WHERE query_id IN (SELECT 'q' || item_id FROM asked WHERE item_id BETWEEN 1000000 AND 1999999) GROUP BY query_id)) AS s)""", False))
def calibration_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold between the weakest match and the strongest of the off-topic queries."""
    negatives = spark.createDataFrame([(q,) for q in E.DEFAULT_NEGATIVES], "query string").withColumn("collection", F.when(F.col("query").isNotNull(), "corpus"))
    gap = E.calibrate(cases(spark, sf_dir), negatives, searcher(spark, sf_dir), LIMIT, True)
    return gap.select(F.round("weakest_positive_score", 6).alias("weakest_positive_score"), F.round("strongest_negative_score", 6).alias("strongest_negative_score"),
                      "has_clean_gap", "suggested_rerank_min_score")


@query("planner_comparison", asked_sql("""found AS (SELECT c.item_id, v.query_id = c.case_id AS raw FROM cases c
  JOIN vtop v ON v.vrank <= 15 AND v.query_id IN (c.case_id, 'q' || (2000000 + c.item_id)) JOIN ch ON ch.chunk_id = v.chunk_id
  WHERE v.chunk_id = c.want OR ch.topic = c.topic),
hit AS (SELECT item_id, bool_or(raw) AS raw_hit, bool_or(NOT raw) AS planned_hit FROM found GROUP BY item_id)""", """
SELECT 'v' || b.item_id AS variant_id, CASE WHEN b.item_id % 4 = 3 THEN 'fallback' ELSE 'ok' END AS planning_status,
  CASE WHEN b.item_id % 4 <> 3 THEN CASE WHEN b.item_id % 5 = 0 THEN 'out_of_scope' ELSE 'content_retrieval' END END AS intent,
  CASE WHEN b.item_id % 3 <> 0 THEN 'content_retrieval' END AS expected_intent, coalesce(raw_hit, FALSE) AS raw_hit, coalesce(planned_hit, FALSE) AS planned_hit
FROM benchmark b LEFT JOIN hit USING (item_id)""", False))
def planner_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against planned retrieval of every variant."""
    k = F.substring("case_id", 2, 20).cast("long")
    variant = F.concat(F.lit("v"), k).alias("variant_id")
    known = cases(spark, sf_dir)
    variants = known.select(variant, "query", "collection", "filters", "any_chunk_ids", "any_topics", F.when(k % 3 != 0, "content_retrieval").alias("expected_intent"))
    plans = known.select(variant, F.when(k % 4 == 3, "fallback").otherwise("ok").alias("planning_status"),
                         F.when(k % 5 == 0, "out_of_scope").otherwise("content_retrieval").alias("intent"),
                         F.array(F.when(k % 4 == 3, F.col("query")).otherwise(F.substring("query", 1, 60))).alias("semantic_queries"))
    return E.compare_planned(variants, plans, searcher(spark, sf_dir), LIMIT)
