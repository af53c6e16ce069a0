"""Evaluation jobs: hit@k, threshold calibration, planner A/B, abstention metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.text import round4
from paperfold.schemas import DECLINE_STATUSES

HIT_LEVELS = (1, 3, 5, 10)

# The default off-topic queries of a calibration run.
DEFAULT_NEGATIVES = (
    "renaissance oil painting glazing techniques",
    "Italian personal income tax filing deadline",
    "heart valve replacement recovery timeline",
    "Shakespeare sonnet meter analysis",
    "NBA playoff bracket seeding rules",
    "sourdough starter hydration troubleshooting",
    "quantum chromodynamics Feynman diagrams",
    "CRISPR Cas9 off target gene editing",
    "lithium ion battery cathode degradation",
    "finite element mesh refinement for bridges",
    "Kubernetes ingress controller TLS termination",
    "Rust borrow checker lifetime elision",
    "compiler register allocation graph coloring",
    "distributed consensus Byzantine fault tolerance",
    "GPU shader texture sampling anisotropy",
    "cryptocurrency proof of stake slashing",
    "large language model RLHF reward hacking",
    "homomorphic encryption bootstrapping circuits",
    "florbnicate zargle tensor marmalade",
    "ZXQ-17 blue banana protocol",
)


def effective_limit(cases: DataFrame, limit: int) -> int:
    """Fetch depth: max(limit, 10, deepest case)."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return max(limit, 10, cases.agg(F.max("top_k")).first()[0] or 10)


def is_match() -> Column:
    """Result row hits its case: expected chunk id or expected topic."""
    return F.coalesce(
        F.array_contains("any_chunk_ids", F.col("chunk_id")), F.lit(False)
    ) | F.coalesce(F.array_contains("any_topics", F.col("topic")), F.lit(False))


def match_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: matched_rank (first), matched_score, passed.

    cases: case_id, any_chunk_ids, any_topics, top_k. results: case_id, rank,
    chunk_id, topic, score.
    """
    hits = results.join(
        cases.select("case_id", "any_chunk_ids", "any_topics"), "case_id"
    ).filter(is_match()).groupBy("case_id").agg(
        F.min("rank").alias("matched_rank"), F.min_by("score", "rank").alias("matched_score")
    )
    return cases.join(hits, "case_id", "left").withColumn(
        "passed", F.coalesce(F.col("matched_rank") <= F.col("top_k"), F.lit(False))
    )


def hit_metrics(matched: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("matched_rank") <= k).alias(f"hit_at_{k}") for k in HIT_LEVELS
    ]
    return matched.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.col("passed")).alias("passed_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        *counts,
    )


def top_scores(results: DataFrame) -> DataFrame:
    """First result's score per query."""
    return results.groupBy("query_id").agg(F.min_by("score", "rank").alias("top_score"))


def score_gap(matched: DataFrame, negative_tops: DataFrame) -> DataFrame:
    """Weakest matched positive, strongest negative, and the midpoint if they part.

    A match deeper than the case's top_k gives no score (its row is not returned).
    """
    none = F.lit(None).cast("double")
    shown = F.when(F.col("matched_rank") <= F.col("top_k"), F.col("matched_score"))
    both = matched.select(shown.alias("pos"), none.alias("neg")).unionByName(
        negative_tops.select(none.alias("pos"), F.col("top_score").alias("neg"))
    ).agg(
        F.min("pos").alias("weakest_positive_score"),
        F.max("neg").alias("strongest_negative_score"),
    )
    low, high = F.col("strongest_negative_score"), F.col("weakest_positive_score")
    clean = F.coalesce(low < high, F.lit(False))
    return both.withColumn("has_clean_gap", clean).withColumn(
        "suggested_rerank_min_score", F.when(clean, round4(low + (high - low) / 2))
    )


def union_queries(*sources: DataFrame) -> DataFrame:
    """Query texts of all sources in order, later duplicates dropped."""
    tagged = [
        s.select(F.lit(i).alias("_src"), F.col("pos"), F.col("query"))
        for i, s in enumerate(sources)
    ]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    first = union.groupBy("query").agg(F.min(F.struct("_src", "pos")).alias("at"))
    return first.select("query", F.col("at._src").alias("source"), F.col("at.pos").alias("pos"))


def planner_ab(variants: DataFrame) -> DataFrame:
    """Raw against planned retrieval over all variants.

    variants: variant_id, raw_hit, planned_hit, planning_status, intent,
    expected_intent.
    """
    labelled = F.col("expected_intent").isNotNull()
    right = labelled & F.coalesce(F.col("intent") == F.col("expected_intent"), F.lit(False))
    misroute = F.coalesce(F.col("expected_intent") == "content_retrieval", F.lit(False)) & ~F.coalesce(
        F.col("intent") == "content_retrieval", F.lit(False)
    )
    n = F.count(F.lit(1))
    return variants.agg(
        n.alias("variant_count"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("planning_status") == "fallback"), n), F.lit(0.0)
        ).alias("fallback_rate"),
        F.coalesce(F.sum(
            F.col("planned_hit").cast("int") - F.col("raw_hit").cast("int")
        ), F.lit(0)).alias("hit_delta_sum"),
        F.try_divide(F.count_if(right), F.count_if(labelled)).alias("intent_accuracy"),
        F.count_if(misroute).alias("misroute_count"),
    )


def planner_misroutes(variants: DataFrame) -> DataFrame:
    """Variants labelled content_retrieval that were routed elsewhere."""
    return variants.filter(
        (F.col("expected_intent") == "content_retrieval")
        & ~F.coalesce(F.col("intent") == "content_retrieval", F.lit(False))
    ).select("variant_id")


def study_flags(variants: DataFrame) -> DataFrame:
    """Per variant: expected chunk in context, expected topic in sources, abstain."""
    negative = F.col("expected_answer_status").isNotNull()
    return variants.withColumn(
        "expected_in_context", F.arrays_overlap("context_chunk_ids", "any_chunk_ids")
    ).withColumn(
        "expected_topic_in_sources", F.arrays_overlap("source_topics", "any_topics")
    ).withColumn("abstain_correct", F.when(
        negative, F.col("answer_status").isin(*DECLINE_STATUSES)
    ))


def abstention_metrics(flagged: DataFrame) -> DataFrame:
    """Abstain recall, false abstains, content hits, requery rate. Empty denominators
    give NULL, except the requery and fallback rates (0)."""
    negative = F.col("expected_answer_status").isNotNull()
    content = ~negative
    n = F.count(F.lit(1))
    hit = F.coalesce(F.col("expected_in_context"), F.lit(False)) | F.coalesce(
        F.col("expected_topic_in_sources"), F.lit(False)
    )
    return flagged.agg(
        F.count_distinct("case_id").alias("case_count"),
        n.alias("variant_count"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("planning_status") == "fallback"), n), F.lit(0.0)
        ).alias("planner_fallback_rate"),
        F.try_divide(
            F.count_if(negative & F.col("abstain_correct")), F.count_if(negative)
        ).alias("abstain_recall"),
        F.try_divide(
            F.count_if(content & (F.col("retrieval_status") == "low_relevance")),
            F.count_if(content),
        ).alias("abstain_false_positive_rate"),
        F.try_divide(F.count_if(content & hit), F.count_if(content)).alias(
            "non_regression_content_hit_rate"
        ),
        F.coalesce(F.try_divide(F.count_if("requery_attempted"), n), F.lit(0.0)).alias(
            "requery_rate"
        ),
        F.count_if(negative & F.col("requery_attempted")).alias("negative_requery_attempts"),
    )


# --- whole jobs ------------------------------------------------------------------
#
# ``searcher`` maps (query_id, query, collection, filters, limit, rerank) to ranked
# results (query_id, rank, chunk_id, score, topic, ...): one search for all cases.

def _asked(rows: DataFrame, key: str, limit: int, rerank: bool) -> DataFrame:
    return rows.select(
        F.col(key).alias("query_id"), "query", "collection", "filters",
        F.lit(limit).alias("limit"), F.lit(rerank).alias("rerank"),
    )


def evaluate(cases: DataFrame, searcher, limit: int, rerank: bool) -> DataFrame:
    """Search evaluation: every case searched once at the common depth, then matched."""
    depth = effective_limit(cases, limit)
    results = searcher(_asked(cases, "case_id", depth, rerank))
    return match_cases(cases, results.withColumnRenamed("query_id", "case_id"))


def calibrate(cases: DataFrame, negatives: DataFrame, searcher, limit: int,
              rerank: bool) -> DataFrame:
    """Threshold calibration. ``searcher`` must run without thresholds.

    negatives: query, collection. Their filters are empty; duplicates count once.
    """
    depth = effective_limit(cases, limit)
    none = F.array().cast(cases.schema["filters"].dataType)
    off_topic = negatives.select("query", "collection").distinct().select(
        F.sha2("query", 256).alias("query_id"), "query", "collection", none.alias("filters"),
    )
    tops = top_scores(searcher(_asked(off_topic, "query_id", depth, rerank)))
    return score_gap(evaluate(cases, searcher, limit, rerank), tops)


def compare_planned(variants: DataFrame, plans: DataFrame, searcher, top_k: int,
                    rerank: bool = False) -> DataFrame:
    """Planner A/B: each variant searched raw and as planned, one row each.

    variants: variant_id, query, collection, filters, any_chunk_ids, any_topics,
    expected_intent. plans: variant_id, planning_status, intent, semantic_queries
    (a fallback plan holds the raw query, so it searches the same text).
    """
    expected = variants.select("variant_id", "any_chunk_ids", "any_topics")

    def hits(rows: DataFrame, name: str) -> DataFrame:
        found = searcher(_asked(rows, "variant_id", top_k, rerank)).withColumnRenamed(
            "query_id", "variant_id"
        )
        return found.join(expected, "variant_id").groupBy("variant_id").agg(
            F.bool_or(is_match()).alias(name)
        )

    planned = variants.join(
        plans.select("variant_id", F.get("semantic_queries", F.lit(0)).alias("_q")),
        "variant_id", "left",
    ).withColumn("query", F.coalesce("_q", "query")).drop("_q")
    df = variants.select("variant_id", "expected_intent").join(
        plans.select(
            "variant_id", "planning_status",
            F.when(F.col("planning_status") == "ok", F.col("intent")).alias("intent"),
        ), "variant_id", "left",
    )
    df = df.join(hits(variants, "raw_hit"), "variant_id", "left")
    df = df.join(hits(planned, "planned_hit"), "variant_id", "left")
    return df.select(
        "variant_id", "planning_status", "intent", "expected_intent",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("raw_hit", "planned_hit")],
    )


def evaluate_study(cases: DataFrame, responses: DataFrame, topics: DataFrame) -> DataFrame:
    """Study evaluation: responses joined to their cases, then the metrics.

    cases: variant_id, case_id, any_chunk_ids, any_topics, expected_answer_status.
    responses: the study job's rows (request_id = variant_id). topics: chunk_id, topic.
    """
    cited = responses.select("request_id", F.explode("source_ids").alias("chunk_id"))
    source_topics = cited.join(topics, "chunk_id").groupBy("request_id").agg(
        F.collect_set("topic").alias("source_topics")
    )
    none = F.array().cast("array<string>")
    joined = cases.join(
        responses.withColumnRenamed("request_id", "variant_id"), "variant_id"
    ).join(source_topics.withColumnRenamed("request_id", "variant_id"), "variant_id", "left")
    return abstention_metrics(study_flags(
        joined.withColumn("source_topics", F.coalesce("source_topics", none))
    ))
