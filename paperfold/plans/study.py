"""Study answers as set-at-a-time stages: plan, retrieve, grade, requery, pack, cite.

The one allowed requery is unrolled into a second retrieval over the requests that
need it, so there is no driver loop. Model outputs (plans, grades, reformulations,
drafts) are input tables of JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.text import nonempty, strip, words
from paperfold.operators import citations as C
from paperfold.operators.packing import (
    CONTEXT_BUDGET,
    SINGLE_CHUNK_CAP,
    dedupe_parent_child,
    pack,
    packing_summary,
    single_cap,
)
from paperfold.schemas import GRADE_DRAFT, PLAN_DRAFT
from paperfold.session import materialise

# Intents, their routes and the texts of direct answers.
INTENT_ROUTES = {
    "content_retrieval": ("retrieval", None),
    "corpus_analytics": ("direct_response", "unsupported_analytics"),
    "ambiguous": ("direct_response", "needs_refinement"),
    "out_of_scope": ("direct_response", "out_of_scope"),
}
DIRECT_MESSAGES = {
    "unsupported_analytics": (
        "I can't compute corpus-wide statistics yet — counts, frequencies, or "
        "trends across papers. I can find and explain specific past questions; "
        "try naming a topic, paper, or year."
    ),
    "needs_refinement": (
        "Your question is a bit broad to answer from past papers. Try naming a "
        "specific topic, paper, or year — or browse the question bank to see "
        "what's covered."
    ),
    "out_of_scope": (
        "That looks outside this past-paper collection, so I can't answer it "
        "from the corpus. Try a topic, concept, or question from the papers "
        "instead."
    ),
}
MAX_QUERY_WORDS = 40
MAX_GUIDANCE_WORDS = 100
HTTP_OUTCOMES = {
    413: "request_too_large", 429: "rate_limited", 504: "timeout",
    503: "service_unavailable", 404: "not_found", 403: "forbidden", 422: "invalid_request",
}
FALLBACK_SOURCES = 10
NOTHING_FOUND = "No past questions matched the query."
ABSTAINED = (
    "No retrieved questions were sufficiently relevant to your query. "
    "Try rephrasing or broadening your topic."
)
GENERATION_FAILED = "Generation failed; showing retrieved sources only."

Searcher = Callable[[DataFrame], DataFrame]


def validate_plans(df: DataFrame) -> DataFrame:
    """query, plan_json, plan_error -> planning_status, intent, semantic_queries,
    guidance, error_category. An unusable plan falls back to the raw query."""
    df = df.withColumn("_d", F.from_json("plan_json", PLAN_DRAFT))
    draft = F.col("_d")
    stray = F.size(F.array_except(
        F.json_object_keys("plan_json"),
        F.array(*[F.lit(n) for n in PLAN_DRAFT.names]),
    )) > 0
    query = strip(F.get(draft["semantic_queries"], F.lit(0)))
    guide = F.when(
        draft["intent"] == "content_retrieval",
        strip(F.coalesce(draft["generation_guidance"], F.lit(""))),
    ).otherwise("")
    df = df.withColumn("_q", query).withColumn("_g", guide)
    shape = (
        draft.isNull() | F.json_object_keys("plan_json").isNull() | F.coalesce(stray, F.lit(True))
        | (F.coalesce(F.size(draft["semantic_queries"]), F.lit(0)) != 1)
        | F.get(draft["semantic_queries"], F.lit(0)).isNull()
        | ~F.coalesce(draft["intent"].isin(*INTENT_ROUTES), F.lit(False))
    )
    error = (
        F.when(F.col("plan_error").isNotNull(), F.col("plan_error"))
        .when(shape, "schema_validation_failed")
        .when((F.col("_q") == "") | (F.size(words("_q")) > MAX_QUERY_WORDS), "invalid_plan")
        .when(F.size(words("_g")) > MAX_GUIDANCE_WORDS, "invalid_plan")
    )
    df = df.withColumn("error_category", error)
    ok = F.col("error_category").isNull()
    return df.select(
        *[c for c in df.columns if c not in ("_d", "_q", "_g", "error_category")],
        F.when(ok, "ok").otherwise("fallback").alias("planning_status"),
        F.when(ok, draft["intent"]).otherwise("content_retrieval").alias("intent"),
        F.array(F.when(ok, F.col("_q")).otherwise(F.col("query"))).alias("semantic_queries"),
        F.when(ok, F.col("_g")).otherwise("").alias("guidance"),
        "error_category",
    )


def route(df: DataFrame) -> DataFrame:
    """Intent -> workflow and, for direct answers, response kind and message."""
    intent = F.coalesce("intent", F.lit("content_retrieval"))

    def pick(values: dict) -> Column:
        return F.coalesce(*[F.when(intent == k, F.lit(v)) for k, v in values.items()])

    kind = pick({k: v[1] for k, v in INTENT_ROUTES.items() if v[1]})
    messages = F.coalesce(*[F.when(F.col("response_kind") == k, F.lit(m))
                            for k, m in DIRECT_MESSAGES.items()])
    return (
        df.withColumn("workflow", pick({k: v[0] for k, v in INTENT_ROUTES.items()}))
        .withColumn("response_kind", kind)
        .withColumn("direct_message", messages)
    )


def grade_decisions(results: DataFrame, grades: DataFrame, second_pass: bool = False,
                    seen: DataFrame | None = None) -> DataFrame:
    """Per request: decision keep / keep_all / requery / abstain, kept ids, critique.

    A failed grader keeps everything. Nothing accepted means one requery on the first
    pass and an abstain on the second. A second pass that shows no unseen chunk
    abstains without looking at its grade.
    """
    lists = results.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_l")
    ).select("request_id", F.transform("_l", lambda x: x["chunk_id"]).alias("retrieved"))
    df = lists.join(grades.select("request_id", "grade_json"), "request_id", "left")
    df = df.withColumn("_d", F.from_json("grade_json", GRADE_DRAFT))
    failed = F.col("_d").isNull() | F.col("_d.accepted_chunk_ids").isNull()
    kept = F.array_intersect("retrieved", "_d.accepted_chunk_ids")
    decision = F.when(failed, "keep_all").when(F.size(kept) > 0, "keep").otherwise(
        "abstain" if second_pass else "requery"
    )
    if seen is not None:
        df = df.join(
            seen.select("request_id", F.col("retrieved").alias("_seen")), "request_id", "left"
        )
        stale = F.size(F.array_except("retrieved", "_seen")) == 0
        decision = F.when(F.coalesce(stale, F.lit(False)), "abstain").otherwise(decision)
    critique = nonempty(strip(F.col("_d.critique")))
    if not second_pass:
        critique = F.coalesce(critique, F.lit("Retrieved chunks did not address the query."))
    return df.withColumn("decision", decision).select(
        "request_id", "decision", "retrieved",
        F.when(F.col("decision") == "keep_all", F.col("retrieved"))
        .when(F.col("decision") == "keep", kept)
        .otherwise(F.array().cast("array<string>")).alias("kept_ids"),
        F.when(F.col("decision").isin("requery", "abstain"), critique).alias("critique"),
    )


def prune(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results kept by the grader, in retrieval order."""
    kept = decisions.select("request_id", F.explode("kept_ids").alias("chunk_id"))
    return results.join(kept, ["request_id", "chunk_id"], "left_semi")


def check_reformulation(reformulated: Column, original: Column) -> Column:
    """New query of at most 40 words; NULL (abstain) when blank or unchanged."""
    text = F.array_join(F.slice(words(reformulated), 1, MAX_QUERY_WORDS), " ")
    return F.when(
        (text != "") & (F.lower(strip(text)) != F.lower(strip(original))), text
    )


def empty_status(has_filters: Column) -> Column:
    return F.when(has_filters, "filtered_empty").otherwise("empty")


def study_outcome(answer_status: Column, retrieval_status: Column,
                  error_category: Column) -> Column:
    """Ordered: a reflection abstain first, or it would read as ok."""
    return (
        F.when(retrieval_status == "low_relevance", "reflection_abstained")
        .when(answer_status.isin("ok", "partial", "insufficient_evidence"), "ok")
        .when(answer_status == "generation_failed",
              F.coalesce(nonempty(error_category), F.lit("generation_failed")))
        .otherwise(answer_status)
    )


def http_outcome(status: Column) -> Column:
    return F.coalesce(
        *[F.when(status == code, F.lit(name)) for code, name in HTTP_OUTCOMES.items()],
        F.lit("error"),
    )


def label_attempts(calls: DataFrame) -> DataFrame:
    """Model calls by response schema; the first generation is primary, later repairs.

    calls: request_id, call_index, schema_title.
    """
    title = F.coalesce("schema_title", F.lit(""))
    kind = (
        F.when(title == "QueryPlanDraft", "planner")
        .when(title == "RelevanceGradingDraft", "grader")
        .when(title == "QueryReformulationDraft", "reflect")
        .otherwise("generation")
    )
    df = calls.withColumn("kind", kind)
    # the first generation by partial aggregation: no per-request sort in one task
    first = df.filter(F.col("kind") == "generation").groupBy("request_id").agg(
        F.min("call_index").alias("_first")
    )
    return df.join(first, "request_id", "left").withColumn("attempt", F.when(
        F.col("kind") == "generation",
        F.when(F.col("call_index") == F.col("_first"), "primary").otherwise("repair"),
    ).otherwise(F.col("kind"))).drop("_first")


def _as_requests(results: DataFrame) -> DataFrame:
    return results.withColumnRenamed("query_id", "request_id")


def study(
    requests: DataFrame,
    plans: DataFrame,
    searcher: Searcher,
    grades: DataFrame,
    reformulations: DataFrame,
    drafts: DataFrame,
    budget: int = CONTEXT_BUDGET,
    cap: int = SINGLE_CHUNK_CAP,
) -> DataFrame:
    """One response row per request.

    requests: request_id, query, collection, filters, top_k. plans: request_id,
    plan_json, plan_error. grades: request_id, pass, grade_json. reformulations:
    request_id, reformulated_query. drafts: request_id, draft_json.
    ``searcher`` maps (query_id, query, collection, filters, limit, rerank) to ranked
    results (query_id, rank, chunk_id, chunk_level, parent_chunk_id, text, score, ...).
    """
    planned = route(validate_plans(requests.join(plans, "request_id", "left")))

    def ask(df: DataFrame, query: Column) -> DataFrame:
        return df.select(
            F.col("request_id").alias("query_id"), query.alias("query"), "collection",
            "filters", F.col("top_k").alias("limit"), F.lit(True).alias("rerank"),
        )

    retrieval = planned.filter(F.col("workflow") == "retrieval")
    first = materialise(
        _as_requests(searcher(ask(retrieval, F.get("semantic_queries", F.lit(0))))), "pass1"
    )
    d1 = grade_decisions(first, grades.filter(F.col("pass") == 1))
    again = d1.filter(F.col("decision") == "requery").join(
        reformulations, "request_id", "left"
    ).join(requests.select("request_id", "query", "collection", "filters", "top_k"), "request_id")
    again = again.withColumn("requery", check_reformulation(
        F.coalesce("reformulated_query", F.lit("")), F.col("query")
    ))
    runnable = again.filter(F.col("requery").isNotNull())
    second = materialise(_as_requests(searcher(ask(runnable, F.col("requery")))), "pass2")
    d2 = grade_decisions(second, grades.filter(F.col("pass") == 2), True, d1)

    final = d1.filter(F.col("decision") != "requery").select(
        "request_id", "decision", "kept_ids", F.size("retrieved").alias("returned"),
        F.lit(False).alias("requery_attempted"),
    ).unionByName(
        again.join(
            d2.select("request_id", F.col("decision").alias("_d2"),
                      F.col("kept_ids").alias("_k2"), F.size("retrieved").alias("_n2")),
            "request_id", "left",
        ).select(
            "request_id",
            F.when(F.col("requery").isNull(), "abstain")
            .otherwise(F.coalesce("_d2", F.lit("empty"))).alias("decision"),
            F.coalesce("_k2", F.array().cast("array<string>")).alias("kept_ids"),
            F.coalesce("_n2", F.lit(0)).alias("returned"),
            F.lit(True).alias("requery_attempted"),
        )
    )
    runs = prune(first, d1.filter(F.col("decision") != "requery")).unionByName(
        prune(second, d2)
    )
    packed = pack(
        dedupe_parent_child(runs.withColumnRenamed("request_id", "query_id")),
        budget, single_cap(cap, budget),
    )
    summary = packing_summary(packed).withColumnRenamed("query_id", "request_id")
    # Where nothing could be packed, the first results of the last search are shown.
    last = first.select("request_id", "chunk_id", "rank").join(
        again.select("request_id"), "request_id", "left_anti"
    ).unionByName(second.select("request_id", "chunk_id", "rank"))
    shown = last.filter(F.col("rank") <= FALLBACK_SOURCES).groupBy("request_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]
    ).alias("first_ids"))

    df = planned.select(
        "request_id", "query", "collection", "workflow", "intent", "direct_message",
        "planning_status", F.col("error_category").alias("planning_error"),
        (F.size("filters") > 0).alias("has_filters"),
    )
    df = df.join(final, "request_id", "left").join(summary, "request_id", "left")
    df = df.join(shown, "request_id", "left").withColumn(
        # Only what the model was shown may be cited.
        "valid_ids", F.coalesce("context_chunk_ids", F.array().cast("array<string>"))
    ).join(
        drafts.select("request_id", "draft_json"), "request_id", "left"
    )
    df = df.withColumn("draft", C.parse_draft(F.col("draft_json")))
    df = df.withColumn("bad_draft", F.size(C.draft_problems("draft_json", "draft")) > 0)
    checked = C.validate_citations(df)
    direct = F.col("workflow") != "retrieval"
    empty = F.col("decision").isNull() | (F.col("decision") == "empty")
    abstain = F.col("decision") == "abstain"
    unpacked = F.col("status") == "context_pack_failed"
    no_draft = F.coalesce(F.col("bad_draft"), F.lit(True)) | F.col("draft").isNull()
    error = (
        F.when(direct | empty | abstain, F.lit(None).cast("string"))
        .when(unpacked, "context_pack_failed")
        .when(no_draft, "schema_validation_failed")
        .otherwise(F.col("error_category"))
    )
    checked = checked.withColumn("generation_error", error).withColumn("final_status", (
        F.when(direct, "no_corpus_answer")
        .when(empty | abstain, "insufficient_evidence")
        .when(F.col("generation_error").isNotNull(), "generation_failed")
        .otherwise(F.col("answer_status"))
    )).withColumn("retrieval_status", (
        F.when(direct, "skipped")
        .when(empty, empty_status(F.col("has_filters")))
        .when(abstain, "low_relevance")
        .otherwise("ok")
    ))
    note = (
        F.when(direct, F.array().cast("array<string>"))
        .when(empty, F.array(F.lit(NOTHING_FOUND)))
        .when(abstain, F.array(F.lit(ABSTAINED)))
        .when(F.col("generation_error").isNotNull(), F.array(F.lit(GENERATION_FAILED)))
        .otherwise(F.col("limitations"))
    )
    answered = F.col("final_status").isin("ok", "partial", "insufficient_evidence") & (
        F.col("retrieval_status") == "ok"
    )
    none = F.array().cast("array<string>")
    return checked.select(
        "request_id", "intent", "planning_status", "planning_error",
        F.col("final_status").alias("answer_status"), "retrieval_status",
        F.when(direct, F.col("direct_message"))
        .when(answered, F.col("draft.overview")).otherwise("").alias("overview"),
        note.alias("limitations"),
        F.when(F.col("retrieval_status") == "ok", F.col("returned")).otherwise(0)
        .alias("returned_result_count"),
        F.coalesce("requery_attempted", F.lit(False)).alias("requery_attempted"),
        F.when(F.col("retrieval_status") == "ok", F.coalesce("context_chunk_ids", none))
        .otherwise(none).alias("context_chunk_ids"),
        F.when(answered, C.cited_ids(F.col("kept_patterns"), F.col("kept_sources")))
        .when(unpacked, F.coalesce("first_ids", none))
        .when(F.col("generation_error").isNotNull(), F.coalesce("context_chunk_ids", none))
        .otherwise(none).alias("source_ids"),
        F.when(answered | F.col("generation_error").isNotNull(), F.col("citation_drops"))
        .otherwise(0).alias("citation_drops"),
        F.col("generation_error").alias("error_category"),
        study_outcome(
            F.col("final_status"), F.col("retrieval_status"), F.col("generation_error")
        ).alias("outcome"),
    )
