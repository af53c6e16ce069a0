"""Queries over evaluation and the study stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.bridge import SCHEMA, with_ctes
from paperfold.catalog.registry import query
from paperfold.catalog.retrieval import RANKED_SQL, ranked_results
from paperfold.operators import citations as C
from paperfold.operators import packing as P
from paperfold.plans import evaluation as E
from paperfold.plans import study as ST


@query("parent_child_dedup", with_ctes("ch", "tok", then=RANKED_SQL + """,
removed AS (SELECT DISTINCT s.query_id, CASE WHEN s.score > p.score THEN p.chunk_id ELSE s.chunk_id END
    AS chunk_id FROM results s JOIN results p ON p.query_id = s.query_id
    AND p.chunk_id = s.parent_chunk_id WHERE s.chunk_level = 'sub_question')""", body="""
SELECT query_id, rank, chunk_id FROM results r WHERE NOT EXISTS (SELECT 1 FROM removed x
  WHERE x.query_id = r.query_id AND x.chunk_id = r.chunk_id)"""))
def parent_child_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedupe_parent_child(ranked_results(spark, sf_dir)).select("query_id", "rank", "chunk_id")


PACK_SQL = """sized AS (
  SELECT query_id, rank, chunk_id, greatest(1, length(text) // 4) > 400 AS truncated,
    CASE WHEN greatest(1, length(text) // 4) > 400 THEN NULL
         ELSE greatest(1, length(text) // 4) END AS own_tokens, text FROM results),
cut AS (SELECT query_id, rank, max(chars) // 1 AS len FROM (
    SELECT query_id, rank, sum(length(word) + 1) OVER (PARTITION BY query_id, rank ORDER BY i) - 1 AS chars
    FROM (SELECT query_id, rank, unnest(string_split(c, ' ')) AS word,
            unnest(generate_series(1, len(string_split(c, ' ')))) AS i
          FROM (SELECT query_id, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c
                FROM sized WHERE truncated))) WHERE chars // 4 <= 392 GROUP BY query_id, rank),
tokens AS (SELECT s.query_id, s.rank, s.chunk_id, s.truncated,
    coalesce(s.own_tokens, greatest(1, (c.len + 34) // 4)) AS tokens
  FROM sized s LEFT JOIN cut c USING (query_id, rank)),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, FALSE AS packed
  FROM (SELECT DISTINCT query_id FROM tokens)
  UNION ALL
  SELECT t.query_id, t.rank, CASE WHEN f.used + t.tokens <= 1000 THEN f.used + t.tokens ELSE f.used END,
    f.used + t.tokens <= 1000
  FROM fold f JOIN tokens t ON t.query_id = f.query_id AND t.rank = f.rank + 1)"""


@query("context_packing", with_ctes("ch", "tok", then=RANKED_SQL + ",\n" + PACK_SQL, body="""
SELECT t.query_id, t.rank, t.chunk_id, t.tokens, t.truncated, f.packed
FROM tokens t JOIN fold f ON f.query_id = t.query_id AND f.rank = t.rank"""))
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing into 1000 tokens, one chunk at most 400."""
    return P.pack(ranked_results(spark, sf_dir), 1000, 400).select(
        "query_id", "rank", "chunk_id", "tokens", "truncated", "packed"
    )


@query("context_texts", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT query_id, md5(string_agg('[SOURCE ' || rank || ']' || chr(10) || 'chunk_id: ' || chunk_id ||
  chr(10) || 'chunk_level: ' || chunk_level || chr(10) || 'score: ' || printf('%.4f', score) || chr(10) ||
  concat_ws(chr(10), 'Year: ' || year, 'Language: ' || lang, 'Length: ' || n_chars,
    'Toxic: ' || CAST(toxic AS VARCHAR), 'Topic: ' || topic) ||
  chr(10) || chr(10) || 'text:' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest
FROM results GROUP BY query_id"""))
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source blocks of all results under a budget that leaves nothing out."""
    packed = P.pack(ranked_results(spark, sf_dir), 10**8, 10**7)
    return P.context_text(packed, SCHEMA).select("query_id", F.md5("context").alias("digest"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per benchmark text: an expected chunk and expected topics."""
    k = F.col("item_id")
    return b.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), k).alias("case_id"),
        F.array(F.concat(F.lit("d"), k * 7 % 50)).alias("any_chunk_ids"),
        F.array(F.concat(F.lit("t"), k % 10), F.concat(F.lit("t"), (k + 1) % 10)).alias("any_topics"),
        F.when(k % 3 == 0, 2).otherwise(10).alias("top_k"),
    )


EVAL_SQL = """cases AS (SELECT 'q' || item_id AS case_id, 'd' || (item_id * 7 % 50) AS want,
    't' || (item_id % 10) AS t1, 't' || ((item_id + 1) % 10) AS t2,
    CASE WHEN item_id % 3 = 0 THEN 2 ELSE 10 END AS top_k FROM benchmark),
hits AS (SELECT c.case_id, min(r.rank) AS matched_rank, arg_min(r.score, r.rank) AS matched_score
  FROM cases c JOIN results r ON r.query_id = c.case_id
  WHERE r.chunk_id = c.want OR r.topic IN (c.t1, c.t2) GROUP BY c.case_id),
matched AS (SELECT c.case_id, c.top_k, h.matched_rank, h.matched_score,
    coalesce(h.matched_rank <= c.top_k, FALSE) AS passed
  FROM cases c LEFT JOIN hits h USING (case_id))"""


def matched_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ranked_results(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    return E.match_cases(eval_cases(spark, sf_dir), results)


@query("eval_cases_matched", with_ctes("ch", "tok", then=RANKED_SQL + ",\n" + EVAL_SQL, body="""
SELECT case_id, matched_rank, round(matched_score, 6) AS matched_score, passed FROM matched"""))
def eval_cases_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_cases(spark, sf_dir).select(
        "case_id", "matched_rank", F.round("matched_score", 6).alias("matched_score"), "passed"
    )


@query("eval_hit_metrics", with_ctes("ch", "tok", then=RANKED_SQL + ",\n" + EVAL_SQL, body="""
SELECT count(*) AS case_count, count(*) FILTER (WHERE passed) AS passed_count,
  count(*) FILTER (WHERE NOT passed) AS failed_count,
  count(*) FILTER (WHERE matched_rank <= 1) AS hit_at_1, count(*) FILTER (WHERE matched_rank <= 3) AS hit_at_3,
  count(*) FILTER (WHERE matched_rank <= 5) AS hit_at_5,
  count(*) FILTER (WHERE matched_rank <= 10) AS hit_at_10 FROM matched"""))
def eval_hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hit_metrics(matched_cases(spark, sf_dir))


@query("threshold_calibration", with_ctes("cent", then="""
best AS (SELECT q.vec_id, q.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), c.vector), 12)
    AS own FROM embeddings q JOIN cent c ON c.label = q.label),
away AS (SELECT q.vec_id, max(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), c.vector), 12))
    AS top FROM embeddings q JOIN cent c ON c.label = (q.label + 1) % 10 GROUP BY q.vec_id)""", body="""
SELECT round(w, 6) AS weakest_positive_score, round(s, 6) AS strongest_negative_score,
  coalesce(s < w, FALSE) AS has_clean_gap,
  CASE WHEN s < w THEN round(s + (w - s) / 2, 4) END AS suggested_rerank_min_score
FROM (SELECT (SELECT min(own) FROM best) AS w, (SELECT max(top) FROM away) AS s)"""))
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its own topic (positive) and the next topic (negative)."""
    from paperfold.operators.vector_search import cosine

    emb = b.table(spark, sf_dir, "embeddings")
    topics = b.topic_queries(spark, sf_dir)
    own = emb.join(topics, "label").select(
        F.round(cosine("embedding", "vector"), 12).alias("matched_score"),
        F.lit(1).alias("matched_rank"), F.lit(5).alias("top_k"),
    )
    away = emb.select(((F.col("label") + 1) % 10).alias("label"), "embedding").join(
        topics, "label"
    ).select(F.round(cosine("embedding", "vector"), 12).alias("top_score"))
    gap = E.score_gap(own, away)
    return gap.select(
        F.round("weakest_positive_score", 6).alias("weakest_positive_score"),
        F.round("strongest_negative_score", 6).alias("strongest_negative_score"),
        "has_clean_gap", "suggested_rerank_min_score",
    )


@query("negative_top_scores", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT query_id, round(arg_min(score, rank), 6) AS top_score FROM results GROUP BY query_id"""))
def negative_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_scores(ranked_results(spark, sf_dir)).select(
        "query_id", F.round("top_score", 6).alias("top_score")
    )


@query("query_union", """
SELECT query, source, min(pos) AS pos FROM (
  SELECT query, pos, source, min(source) OVER (PARTITION BY query) AS first FROM (
    SELECT text AS query, item_id AS pos, 0 AS source FROM benchmark
    UNION ALL SELECT text, conv_id * 1000 + turn, 1 FROM conversations WHERE role = 'user'))
WHERE source = first GROUP BY query, source""")
def query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = b.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("pos"), F.col("text").alias("query")
    )
    asked = b.table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.col("text").alias("query"),
    )
    return E.union_queries(listed, asked)


AB_SQL = """ab AS (SELECT 'x' || event_id AS variant_id, event_id % 3 = 0 AS raw_hit,
    event_id % 2 = 0 AS planned_hit, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'ambiguous'
         ELSE 'content_retrieval' END AS intent,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'ambiguous'
         ELSE 'content_retrieval' END AS expected FROM events)"""


def ab_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, failed = F.col("event_id"), F.col("event_type") == "error"
    return b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("x"), k).alias("variant_id"), (k % 3 == 0).alias("raw_hit"),
        (k % 2 == 0).alias("planned_hit"),
        F.when(failed, "fallback").otherwise("ok").alias("planning_status"),
        F.when(~failed, F.when(k % 5 == 0, "ambiguous").otherwise("content_retrieval")).alias("intent"),
        F.when(k % 4 == 1, "ambiguous").when(k % 4 != 0, "content_retrieval").alias("expected_intent"),
    )


@query("planner_ab", "WITH " + AB_SQL + """
SELECT count(*) AS variant_count, round(avg(CASE WHEN status = 'fallback' THEN 1.0 ELSE 0 END), 6) AS fallback_rate,
  sum(CAST(planned_hit AS INT) - CAST(raw_hit AS INT)) AS hit_delta_sum,
  round(avg(CASE WHEN expected IS NULL THEN NULL WHEN intent = expected THEN 1.0 ELSE 0 END), 6) AS intent_accuracy,
  count(*) FILTER (WHERE expected = 'content_retrieval' AND intent IS DISTINCT FROM 'content_retrieval')
    AS misroute_count FROM ab""")
def planner_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.planner_ab(ab_variants(spark, sf_dir))
    return out.withColumn("fallback_rate", F.round("fallback_rate", 6)).withColumn(
        "intent_accuracy", F.round("intent_accuracy", 6)
    )


@query("planner_misroutes", "WITH " + AB_SQL + """
SELECT variant_id FROM ab
WHERE expected = 'content_retrieval' AND intent IS DISTINCT FROM 'content_retrieval'""")
def planner_misroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.planner_misroutes(ab_variants(spark, sf_dir))


def study_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return b.table(spark, sf_dir, "events").select(
        (k % 500).alias("case_id"),
        F.when(k % 5 == 0, "insufficient_evidence").alias("expected_answer_status"),
        F.when(k % 3 == 0, "insufficient_evidence").when(k % 7 == 0, "no_corpus_answer")
        .otherwise("ok").alias("answer_status"),
        F.when(k % 11 == 0, "low_relevance").otherwise("ok").alias("retrieval_status"),
        F.array(F.concat(F.lit("d"), k % 4), F.lit("d9")).alias("context_chunk_ids"),
        F.array(F.lit("d1")).alias("any_chunk_ids"),
        F.array(F.concat(F.lit("t"), k % 6)).alias("source_topics"),
        F.array(F.lit("t2"), F.lit("t3")).alias("any_topics"),
        (F.col("event_type") == "click").alias("requery_attempted"),
        F.when(F.col("event_type") == "error", "fallback").otherwise("ok").alias("planning_status"),
    )


@query("abstention_metrics", """
SELECT count(DISTINCT event_id % 500) AS case_count, count(*) AS variant_count,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS planner_fallback_rate,
  round(avg(CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 1.0 ELSE 0 END END), 6)
    AS abstain_recall,
  round(avg(CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 11 = 0 THEN 1.0 ELSE 0 END END), 6)
    AS abstain_false_positive_rate,
  round(avg(CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 4 = 1 OR event_id % 6 IN (2, 3)
    THEN 1.0 ELSE 0 END END), 6) AS non_regression_content_hit_rate,
  round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS requery_rate,
  count(*) FILTER (WHERE event_id % 5 = 0 AND event_type = 'click') AS negative_requery_attempts
FROM events""")
def abstention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.abstention_metrics(E.study_flags(study_variants(spark, sf_dir)))
    rates = ("planner_fallback_rate", "abstain_recall", "abstain_false_positive_rate",
             "non_regression_content_hit_rate", "requery_rate")
    for name in rates:
        out = out.withColumn(name, F.round(name, 6))
    return out


def plan_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations turns as raw queries with planner output of mixed quality."""
    k = F.col("conv_id") + F.col("turn")
    intent = F.when(k % 7 == 6, "unheard_of").when(k % 3 == 1, "ambiguous").otherwise("content_retrieval")
    plan = F.to_json(F.struct(
        F.array(F.concat(F.lit(" "), F.col("text"))).alias("semantic_queries"),
        intent.alias("intent"), F.lit(" be brief ").alias("generation_guidance"),
        F.when(k % 7 == 4, "x").alias("extra"),
    ))
    return b.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("query"),
        F.when(k % 7 == 3, "{").otherwise(plan).alias("plan_json"),
        F.when(k % 7 == 2, "provider_timeout").alias("plan_error"),
    )


@query("plan_validation", """
SELECT request_id, CASE WHEN err IS NULL THEN 'ok' ELSE 'fallback' END AS planning_status, err AS error_category,
  CASE WHEN err IS NULL AND k % 3 = 1 THEN 'ambiguous' ELSE 'content_retrieval' END AS intent,
  CASE WHEN err IS NULL AND k % 3 = 1 THEN 'direct_response' ELSE 'retrieval' END AS workflow,
  CASE WHEN err IS NULL AND k % 3 = 1 THEN 'needs_refinement' END AS response_kind,
  CASE WHEN err IS NULL AND k % 3 <> 1 THEN 'be brief' ELSE '' END AS guidance,
  md5(CASE WHEN err IS NULL THEN trim(text, ' ' || chr(10)) ELSE text END) AS query_digest
FROM (SELECT *, CASE WHEN k % 7 = 2 THEN 'provider_timeout'
    WHEN k % 7 IN (3, 4, 6) THEN 'schema_validation_failed'
    WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 40 THEN 'invalid_plan' END AS err
  FROM (SELECT conv_id || '-' || turn AS request_id, conv_id + turn AS k, text FROM conversations))""")
def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ST.route(ST.validate_plans(plan_outputs(spark, sf_dir)))
    return out.select(
        "request_id", "planning_status", "error_category", "intent", "workflow", "response_kind",
        "guidance", F.md5(F.get("semantic_queries", F.lit(0))).alias("query_digest"),
    )


def grades(results: DataFrame) -> DataFrame:
    """Grader output per benchmark query: of its results (request_id, chunk_id), at most as
    many as the search limit, those with an id of the query's parity are accepted."""
    k = F.substr("request_id", F.lit(2)).cast("bigint")
    own = F.substr("chunk_id", F.lit(2)).cast("bigint") % 2 == k % 2
    accepted = F.collect_list(F.when(own & (k % 4 != 0), F.col("chunk_id")))
    good = F.to_json(F.struct(F.col("accepted").alias("accepted_chunk_ids"), F.lit("").alias("critique")))
    return results.groupBy("request_id").agg(accepted.alias("accepted")).select(
        "request_id", F.lit(1).alias("pass"), F.when(k % 5 == 3, "not json").otherwise(good).alias("grade_json"),
    )


@query("grade_decisions", with_ctes("ch", "tok", then=RANKED_SQL + """,
g AS (SELECT r.*, CAST(r.query_id[2:] AS BIGINT) AS k, CAST(r.chunk_id[2:] AS BIGINT) AS n FROM results r),
a AS (SELECT query_id, k, count(*) AS retrieved,
   count(*) FILTER (WHERE k % 4 <> 0 AND n % 2 = k % 2) AS kept FROM g GROUP BY ALL)""", body="""
SELECT query_id AS request_id, retrieved, CASE WHEN k % 5 = 3 THEN 'keep_all' WHEN kept > 0 THEN 'keep'
    ELSE 'requery' END AS decision,
  CASE WHEN k % 5 = 3 THEN retrieved WHEN kept > 0 THEN kept ELSE 0 END AS kept FROM a"""))
def grade_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ranked_results(spark, sf_dir).withColumnRenamed("query_id", "request_id")
    out = ST.grade_decisions(results, grades(results))
    return out.select("request_id", F.size("retrieved").alias("retrieved"), "decision",
                      F.size("kept_ids").alias("kept"))


@query("reformulations", """
SELECT request_id, CASE WHEN k % 3 = 0 OR lower(w) = lower(trim(text, ' ' || chr(10))) THEN NULL ELSE md5(w) END
  AS digest FROM (
  SELECT conv_id || '-' || turn AS request_id, conv_id + turn AS k, text,
    array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:40], ' ') AS w
  FROM conversations)""")
def reformulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    return b.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.md5(ST.check_reformulation(
            F.when(k % 3 == 0, F.upper("text").substr(1, 0)).otherwise(F.col("text")), F.col("text")
        )).alias("digest"),
    )


@query("attempt_labels", """
SELECT event_id, kind, CASE WHEN kind <> 'generation' THEN kind WHEN row_number() OVER (
    PARTITION BY user_id, day, kind ORDER BY event_id) = 1 THEN 'primary' ELSE 'repair' END AS attempt
FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 'planner'
    WHEN 'view' THEN 'grader' WHEN 'signup' THEN 'reflect' ELSE 'generation' END AS kind FROM events)""")
def attempt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    calls = b.table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("/", "user_id", F.to_date("ts")).alias("request_id"),
        F.col("event_id").alias("call_index"),
        F.when(e == "click", "QueryPlanDraft").when(e == "view", "RelevanceGradingDraft")
        .when(e == "signup", "QueryReformulationDraft").alias("schema_title"),
    )
    return ST.label_attempts(calls).select("event_id", "kind", "attempt")


@query("outcomes", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'reflection_abstained'
  WHEN event_id % 3 = 0 THEN 'ok' WHEN event_id % 3 = 1 THEN 'generation_failed'
  ELSE 'no_corpus_answer' END AS outcome,
  CASE event_type WHEN 'click' THEN 'rate_limited' WHEN 'view' THEN 'timeout'
    WHEN 'error' THEN 'error' ELSE 'forbidden' END AS http_outcome FROM events""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id"), F.col("event_type")
    return b.table(spark, sf_dir, "events").select(
        "event_id", ST.study_outcome(
            F.when(k % 3 == 0, "partial").when(k % 3 == 1, "generation_failed")
            .otherwise("no_corpus_answer"),
            F.when(k % 11 == 0, "low_relevance").otherwise("ok"),
            F.lit(None).cast("string"),
        ).alias("outcome"),
        ST.http_outcome(F.when(e == "click", 429).when(e == "view", 504).when(e == "error", 500)
                        .otherwise(403)).alias("http_outcome"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts citing each query's results: exact, with an invented part, or unknown."""
    results = ranked_results(spark, sf_dir)
    cited = (
        F.when(F.col("rank") % 4 == 1, F.concat("chunk_id", F.lit("(i)")))
        .when(F.col("rank") % 4 == 3, F.concat(F.lit("zz"), "chunk_id"))
        .otherwise(F.col("chunk_id"))
    )
    lists = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", cited.alias("cited")))).alias("l")
    )
    ids = F.transform("l", lambda x: x["cited"])
    draft = F.struct(
        F.lit("ok").alias("answer_status"), F.lit("overview").alias("overview"),
        F.array(
            F.struct(F.lit("first").alias("label"), F.lit("s").alias("summary"),
                     F.slice(ids, 1, 4).alias("supporting_chunk_ids")),
            F.struct(F.lit("second").alias("label"), F.lit("s").alias("summary"),
                     F.slice(ids, 3, 1).alias("supporting_chunk_ids")),
        ).alias("patterns"),
        F.transform(F.slice(ids, 2, 9), lambda i: F.struct(
            i.alias("chunk_id"), F.concat(F.lit("because "), i).alias("why_cited")
        )).alias("cited_sources"),
        F.array().cast("array<string>").alias("limitations"),
    )
    return lists.select(
        F.col("query_id").alias("request_id"), draft.alias("draft"), F.to_json(draft).alias("raw"),
        F.transform("l", lambda x: x["chunk_id"]).alias("valid_ids"),
    )


CITE_SQL = """cite AS (
  SELECT query_id, rank, chunk_id, rank % 4 = 3 AS lost FROM results),
p AS (SELECT query_id,
    count(*) FILTER (WHERE rank <= 4 AND lost) + count(*) FILTER (WHERE rank = 3 AND lost)
      + count(*) FILTER (WHERE rank BETWEEN 2 AND 10 AND lost) AS drops,
    count(*) FILTER (WHERE rank <= 4 AND NOT lost) AS in_first,
    count(*) FILTER (WHERE rank BETWEEN 2 AND 10 AND NOT lost) AS kept_sources,
    count(*) AS n FROM cite GROUP BY query_id)"""


@query("citation_validation", with_ctes("ch", "tok", then=RANKED_SQL + ",\n" + CITE_SQL, body="""
SELECT query_id AS request_id, drops AS citation_drops,
  CAST(in_first > 0 AS INT) AS kept_patterns, kept_sources,
  CASE WHEN drops > 0 THEN 'partial' ELSE 'ok' END AS answer_status,
  CAST(drops > 0 AS INT) AS n_limitations FROM p"""))
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.validate_citations(drafts(spark, sf_dir))
    return out.select(
        "request_id", "citation_drops", F.size("kept_patterns").alias("kept_patterns"),
        F.size("kept_sources").alias("kept_sources"), "answer_status",
        F.size("limitations").alias("n_limitations"),
    )


@query("source_cards", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT query_id AS request_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pos, chunk_id,
  CASE WHEN rank >= 2 THEN 'because ' || CASE WHEN rank % 4 = 1 THEN chunk_id || '(i)' ELSE chunk_id END END
    AS why_cited, md5(text[1:500]) AS excerpt_digest
FROM results WHERE rank <= 10 AND rank % 4 <> 3"""))
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ranked_results(spark, sf_dir).withColumnRenamed("query_id", "request_id")
    cards = C.source_cards(C.validate_citations(drafts(spark, sf_dir)), results)
    return cards.select("request_id", "pos", "chunk_id", "why_cited",
                        F.md5("excerpt").alias("excerpt_digest"))


@query("fallback_cards", with_ctes("ch", "tok", then=RANKED_SQL + ",\n" + PACK_SQL, body="""
SELECT t.query_id AS request_id, t.rank, t.chunk_id FROM tokens t
JOIN fold f ON f.query_id = t.query_id AND f.rank = t.rank AND f.packed"""))
def fallback_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = P.pack(ranked_results(spark, sf_dir), 1000, 400)
    cards = C.fallback_cards(packed.withColumnRenamed("query_id", "request_id"))
    return cards.select("request_id", "rank", "chunk_id")


@query("dropped_citations", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT query_id AS request_id, coalesce(string_agg('zz' || chunk_id, ',' ORDER BY rank)
  FILTER (WHERE rank <= 10 AND rank % 4 = 3), '') AS dropped FROM results GROUP BY query_id"""))
def dropped_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft ids that match no result even after resolving invented parts."""
    df = drafts(spark, sf_dir).withColumn("final_ids", F.concat(
        "valid_ids", F.transform("valid_ids", lambda v: F.concat(v, F.lit("(i)")))
    ))
    return C.dropped_citations(df, "final_ids").select(
        "request_id", F.array_join("dropped_chunk_ids", ",").alias("dropped")
    )


@query("draft_problems", """
SELECT conv_id, turn, concat_ws(',', CASE WHEN k % 6 = 0 THEN 'extra_keys' END,
  CASE WHEN k % 5 = 0 THEN 'bad_status' END,
  CASE WHEN length(text) > 1200 THEN 'bad_overview' END,
  CASE WHEN length(text) > 80 THEN 'bad_label' END,
  CASE WHEN length(text) > 500 THEN 'bad_summary' END,
  CASE WHEN k % 4 = 0 THEN 'bad_support' END,
  CASE WHEN length(text) > 400 THEN 'bad_why' END) AS problems
FROM (SELECT *, conv_id + turn AS k FROM conversations)""")
def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations texts as drafts: every constraint they break."""
    k, t = F.col("conv_id") + F.col("turn"), F.col("text")
    ids = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d1")))
    raw = F.to_json(F.struct(
        F.when(k % 5 == 0, "great").otherwise("ok").alias("answer_status"), t.alias("overview"),
        F.array(F.struct(t.alias("label"), t.alias("summary"), ids.alias("supporting_chunk_ids")))
        .alias("patterns"),
        F.array(F.struct(F.lit("d1").alias("chunk_id"), t.alias("why_cited"))).alias("cited_sources"),
        F.array(F.lit("x")).alias("limitations"),
        F.when(k % 6 == 0, "y").alias("mood"),
    ))
    df = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    df = df.withColumn("draft", C.parse_draft(F.col("raw")))
    return df.select("conv_id", "turn", F.array_join(C.draft_problems(), ",").alias("problems"))
