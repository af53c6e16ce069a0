import json

from pyspark.sql import functions as F

from paperfold.plans import evaluation as E
from paperfold.sources.files import write_report

FILTERS = "array<struct<field:string,op:string,value:string,value_type:string>>"


def searcher_over(spark, table):
    rows = [(q, r + 1, c, s, t) for q, hits in table.items() for r, (c, s, t) in enumerate(hits)]
    store = spark.createDataFrame(rows, "query string, rank int, chunk_id string, score double, topic string")

    def search(queries):
        return queries.join(store, "query").filter(F.col("rank") <= F.col("limit")).select(
            "query_id", "rank", "chunk_id", "score", "topic"
        )

    return search


def test_evaluate_and_calibrate(spark, tmp_path):
    search = searcher_over(spark, {
        "qa": [("x", 0.9, "t9"), ("a", 0.8, "t1")],
        "qb": [("b", 0.7, "t2")],
        "qc": [("z", 0.6, None)],
        "noise": [("n", 0.5, None)],
    })
    cases = spark.createDataFrame(
        [("a", "qa", "c", [], ["a"], [], 2), ("b", "qb", "c", [], [], ["t2"], 1),
         ("c", "qc", "c", [], ["q"], [], 12)],
        f"case_id string, query string, collection string, filters {FILTERS}, "
        "any_chunk_ids array<string>, any_topics array<string>, top_k int")
    assert E.effective_limit(cases, 5) == 12
    metrics = E.hit_metrics(E.evaluate(cases, search, 5, False))
    row = metrics.first()
    assert (row.case_count, row.passed_count, row.hit_at_1, row.hit_at_3) == (3, 2, 1, 2)
    negatives = spark.createDataFrame([("noise", "c"), ("noise", "c"), ("void", "c")],
                                      "query string, collection string")
    gap = E.calibrate(cases, negatives, search, 5, False).first()
    assert (gap.weakest_positive_score, gap.strongest_negative_score) == (0.7, 0.5)
    assert gap.suggested_rerank_min_score == 0.6
    write_report(metrics, str(tmp_path / "report"))
    text = spark.read.text(str(tmp_path / "report")).first()[0]
    assert list(json.loads(text)) == sorted(json.loads(text))


def test_planner_ab_job(spark):
    search = searcher_over(spark, {"raw1": [("x", 1.0, None)], "better": [("a", 1.0, None)],
                                   "raw2": [("a", 1.0, None)]})
    variants = spark.createDataFrame(
        [("v1", "raw1", "c", [], ["a"], [], "content_retrieval"), ("v2", "raw2", "c", [], ["a"], [], None)],
        f"variant_id string, query string, collection string, filters {FILTERS}, "
        "any_chunk_ids array<string>, any_topics array<string>, expected_intent string")
    plans = spark.createDataFrame(
        [("v1", "ok", "content_retrieval", ["better"]), ("v2", "fallback", "content_retrieval", ["raw2"])],
        "variant_id string, planning_status string, intent string, semantic_queries array<string>")
    row = E.planner_ab(E.compare_planned(variants, plans, search, 5)).first()
    assert (row.variant_count, row.hit_delta_sum, row.fallback_rate, row.intent_accuracy) == (2, 1, 0.5, 1.0)


def test_study_metrics_golden(spark):
    cases = spark.createDataFrame(
        [("n", "n", [], [], "insufficient_evidence"), ("p", "p", ["a"], [], None)],
        "variant_id string, case_id string, any_chunk_ids array<string>, any_topics array<string>, "
        "expected_answer_status string")
    responses = spark.createDataFrame(
        [("n", "insufficient_evidence", "low_relevance", "ok", True, [], []),
         ("p", "ok", "ok", "ok", False, ["a"], ["a"])],
        "request_id string, answer_status string, retrieval_status string, planning_status string, "
        "requery_attempted boolean, context_chunk_ids array<string>, source_ids array<string>")
    topics = spark.createDataFrame([("a", "t")], "chunk_id string, topic string")
    row = E.evaluate_study(cases, responses, topics).first()
    assert (row.abstain_recall, row.abstain_false_positive_rate) == (1.0, 0.0)
    assert (row.non_regression_content_hit_rate, row.requery_rate) == (1.0, 0.5)
    assert row.negative_requery_attempts == 1
