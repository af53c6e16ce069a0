"""Queries that run as streams, and the end-to-end jobs.

Each stream reads a driver table as a file stream with an availableNow trigger, writes
to the session's shared folder and returns what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.corpus import bracket_papers
from paperfold.catalog.registry import query
from paperfold.catalog.retrieval import RANKED_SQL
from paperfold.catalog.study import PACK_SQL
from paperfold.functions.providers import hashing_embedder, lexical_overlap
from paperfold.plans import chunking as CH
from paperfold.plans import indexing as IX
from paperfold.plans import search as S
from paperfold.plans import study as ST
from paperfold.session import discard, fresh_dir, materialise
from paperfold.streaming import jobs as J
from paperfold.streaming import rate_limit as R
from paperfold.streaming import usage as U
from paperfold.streaming import visibility as V

SECRET = "pepper"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = b.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(writer) -> None:
    done = writer.trigger(availableNow=True).start()
    try:
        done.awaitTermination()
    finally:
        done.stop()


def messages(events: DataFrame) -> DataFrame:
    """events as queue messages of varying validity."""
    k = F.col("event_id") % 9
    body = F.to_json(F.struct(
        F.when(k == 1, "ingest_job_v0").otherwise("ingest_job_v1").alias("schema_version"),
        F.concat(F.lit("j"), F.col("event_id")).alias("job_id"),
        F.when(k == 2, "").otherwise(F.concat(F.lit("src"), F.col("event_id") % 20)).alias("collection"),
        F.concat(F.lit("source-pdfs/d"), F.col("user_id"),
                 F.when(k == 3, ".txt").otherwise(".PDF")).alias("paper_object_key"),
        F.when(k == 4, "other").otherwise("cambridge").alias("parser"),
        F.lit("cam").alias("university"),
        F.when(k == 5, "x").alias("note"),
        F.when(k == 6, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("enqueued_at"),
    ))
    return events.select("event_id", F.when(k == 7, F.lit("{broken")).otherwise(body).alias("body"))


@query("job_messages", """
SELECT event_id, CASE WHEN event_id % 9 IN (0, 8) THEN 'j' || event_id END AS job_id,
  CASE event_id % 9 WHEN 1 THEN 'wrong_schema_version' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'not_a_pdf'
    WHEN 4 THEN 'unknown_parser' WHEN 5 THEN 'extra_keys' WHEN 6 THEN 'bad_timestamp' WHEN 7 THEN 'bad_json' END
    AS problem FROM events""")
def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message stream split into jobs and dead letters."""
    dead, live = fresh_dir(spark, "dead"), fresh_dir(spark, "live")

    def keep(jobs: DataFrame, batch_id: int) -> None:
        jobs.select("event_id", "job_id").write.mode("overwrite").parquet(f"{live}/batch={batch_id}")

    run_to_end(J.ingest_stream(
        messages(table_stream(spark, sf_dir, "events")), keep, dead, fresh_dir(spark, "ckpt"), with_id=True
    ))
    return spark.read.parquet(live).select(
        "event_id", "job_id", F.lit(None).cast("string").alias("problem")
    ).unionByName(spark.read.parquet(dead).select(
        "event_id", F.lit(None).cast("string").alias("job_id"), "problem"
    ))


FATE_SQL = """
SELECT job_id, CASE WHEN first_ok <= 3 THEN first_ok WHEN n >= 3 THEN 3 ELSE n END AS receives,
  CASE WHEN first_ok <= 3 THEN 'acked' WHEN n >= 3 THEN 'dead_letter' ELSE 'retry' END AS fate
FROM (SELECT 'j' || user_id AS job_id, count(*) AS n, min(rn) FILTER (WHERE ok) AS first_ok FROM (
    SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events) GROUP BY user_id)"""


def receives(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        *more,
        F.concat(F.lit("j"), F.col("user_id")).alias("job_id"),
        (F.col("event_type") == "purchase").alias("ok"), F.col("event_id").alias("seq"),
    )


@query("job_attempts", FATE_SQL)
def job_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.attempts(receives(b.table(spark, sf_dir, "events")))


@query("job_attempt_stream", """
SELECT job_id, CASE WHEN first_ok <= 3 THEN first_ok ELSE 3 END AS receives,
  CASE WHEN first_ok <= 3 THEN 'acked' ELSE 'dead_letter' END AS fate
FROM (SELECT 'j' || user_id AS job_id, count(*) AS n, min(rn) FILTER (WHERE ok) AS first_ok FROM (
    SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events) GROUP BY user_id)
WHERE first_ok <= 3 OR n >= 3""")
def job_attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful form: a job is emitted when acknowledged or at its third receive."""
    out = fresh_dir(spark, "fates")
    run_to_end(U.usage_sink(
        J.attempt_fates(receives(table_stream(spark, sf_dir, "events"))), out, fresh_dir(spark, "ckpt")
    ))
    return spark.read.parquet(out)


@query("visibility_timeouts", """
WITH RECURSIVE seq AS (SELECT 'j' || user_id AS job_id, epoch_us(ts) AS t, event_type = 'purchase' AS ok,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
mark AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS w FROM events),
run AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS dead FROM seq
  UNION ALL
  SELECT job_id, rn, t, CASE WHEN flight IS NULL THEN CASE WHEN NOT ok THEN t END WHEN ok THEN NULL ELSE flight END, CASE WHEN ok THEN flight END, gone
  FROM (SELECT s.job_id, s.rn, s.t, s.ok, CASE WHEN r.began + 8100000000 > s.t THEN r.began END AS flight, CASE WHEN r.began + 8100000000 <= s.t THEN r.began END AS gone
    FROM run r JOIN seq s ON s.job_id = r.job_id AND s.rn = r.rn + 1)),
last AS (SELECT job_id, began, greatest(t, w) AS w FROM run, mark WHERE rn > 0 AND began IS NOT NULL
  AND rn = (SELECT max(rn) FROM seq WHERE seq.job_id = run.job_id)),
cycles AS (SELECT job_id, ended AS began, t AS upto, TRUE AS acked FROM run WHERE ended IS NOT NULL
  UNION ALL SELECT job_id, dead, dead + 8100000000, FALSE FROM run WHERE dead IS NOT NULL
  UNION ALL SELECT job_id, began, least(w, began + 8100000000), FALSE FROM last)
SELECT job_id, event, receives, at_us FROM (
  SELECT job_id, 'received' AS event, k + 1 AS receives, began + k * 2700000000 AS at_us FROM cycles, range(3) n(k) WHERE k = 0 OR began + k * 2700000000 <= upto
  UNION ALL SELECT job_id, 'acked', (upto - began) // 2700000000 + 1, upto FROM cycles WHERE acked
  UNION ALL SELECT job_id, 'dead_letter', 3, upto FROM cycles WHERE NOT acked AND upto = began + 8100000000)""")
def visibility_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as receives (purchases acknowledge): what comes back after 45 minutes, and what
    is given up after the third receive."""
    out = fresh_dir(spark, "flights")
    rows = receives(table_stream(spark, sf_dir, "events").withColumn("_ts", F.col("ts").cast("timestamp")), "_ts")
    run_to_end(U.usage_sink(V.flights(rows.withColumnRenamed("_ts", "ts")), out, fresh_dir(spark, "ckpt")))
    return spark.read.parquet(out)


def limit_requests(events: DataFrame) -> DataFrame:
    """events as search and study requests of users and addresses."""
    anonymous = F.col("event_type") == "error"
    rows = events.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 2 == 0, "search").otherwise("study").alias("endpoint"),
        F.when(~anonymous, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"))).alias("edge_ip"),
        F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("h"), F.col("user_id"))).alias("client_host"),
    )
    return R.with_identity(rows, SECRET)



@query("rate_limit_windows", """
SELECT policy, scope, window_start, count(*) AS n,
  count(*) > CASE policy WHEN 'search:user' THEN 60 WHEN 'search:ip' THEN 20 WHEN 'study:user' THEN 10 ELSE 3 END
    AS over_limit
FROM (SELECT endpoint || ':' || scope AS policy, scope, raw,
        epoch(ts)::BIGINT // CASE endpoint WHEN 'search' THEN 60 ELSE 3600 END *
          CASE endpoint WHEN 'search' THEN 60 ELSE 3600 END AS window_start
      FROM (SELECT date_trunc('second', ts) AS ts, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'study' END AS endpoint,
        CASE WHEN event_type <> 'error' THEN 'user' ELSE 'ip' END AS scope,
        CASE WHEN event_type <> 'error' THEN 'u' || user_id WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id
             WHEN user_id % 3 = 1 THEN 'h' || user_id ELSE 'unknown-client' END AS raw FROM events))
GROUP BY policy, scope, raw, window_start""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.window_counts(limit_requests(b.table(spark, sf_dir, "events")))
    return counts.select(
        "policy", F.substring_index("policy", ":", -1).alias("scope"), "window_start", "n", "over_limit"
    )


@query("rate_limit_decisions", """
WITH RECURSIVE ev AS (
  SELECT event_id, epoch_us(ts) / 1e6 AS t, endpoint || ':' || scope AS policy, size,
    CASE endpoint || ':' || scope WHEN 'search:user' THEN 60 WHEN 'search:ip' THEN 20 WHEN 'study:user' THEN 10
      ELSE 3 END AS lim, endpoint || ':' || scope || ':' || raw AS key
  FROM (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'study' END AS endpoint,
    CASE WHEN event_id % 2 = 0 THEN 60 ELSE 3600 END AS size,
    CASE WHEN event_type <> 'error' THEN 'user' ELSE 'ip' END AS scope,
    CASE WHEN event_type <> 'error' THEN 'u' || user_id WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id
         WHEN user_id % 3 = 1 THEN 'h' || user_id ELSE 'unknown-client' END AS raw FROM events)),
seq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, CAST(event_id AS VARCHAR)) AS rn,
    CAST(floor(t / size) AS BIGINT) AS b FROM ev),
run AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(-2 AS BIGINT) AS b, CAST(0 AS BIGINT) AS prev,
    CAST(0 AS BIGINT) AS curr, CAST(NULL AS BIGINT) AS event_id, FALSE AS allowed, CAST(0 AS BIGINT) AS used
  FROM (SELECT DISTINCT key FROM seq)
  UNION ALL
  SELECT key, rn, b, prev, curr + CAST(used < lim AS BIGINT), event_id, used < lim, used
  FROM (SELECT *, CAST(floor(prev * (1 - (t - b * size) / size)) AS BIGINT) + curr AS used
    FROM (SELECT s.key, s.rn, s.b, s.t, s.size, s.lim, s.event_id,
        CASE WHEN s.b = r.b THEN r.prev WHEN s.b = r.b + 1 THEN r.curr ELSE 0 END AS prev,
        CASE WHEN s.b = r.b THEN r.curr ELSE 0 END AS curr
      FROM run r JOIN seq s ON s.key = r.key AND s.rn = r.rn + 1)))
SELECT CAST(r.event_id AS VARCHAR) AS request_id, s.policy, r.allowed,
  greatest(0, s.lim - r.used - CAST(r.allowed AS BIGINT)) AS remaining, (s.b + 1) * s.size AS reset_epoch,
  CASE WHEN r.allowed THEN 0 ELSE greatest(1, CAST(ceil((s.b + 1) * s.size - s.t) AS BIGINT)) END AS retry_after
FROM run r JOIN seq s ON s.event_id = r.event_id""")
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact allowed/denied per request from the stateful counter."""
    out = fresh_dir(spark, "decisions")
    run_to_end(U.usage_sink(
        R.decide(limit_requests(table_stream(spark, sf_dir, "events"))), out, fresh_dir(spark, "ckpt")
    ))
    return spark.read.parquet(out).drop("identity")


def usage_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 3)).alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"), F.col("value").alias("latency"),
    )


@query("usage_log_stream", """
SELECT 'r' || (event_id // 3) AS request_id, 1 AS n FROM events GROUP BY event_id // 3""")
def usage_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage row per request id, however often it was delivered."""
    out = fresh_dir(spark, "usage")
    rows = U.first_per_request(usage_rows(table_stream(spark, sf_dir, "events")), "60 days")
    run_to_end(U.usage_sink(rows, out, fresh_dir(spark, "ckpt")))
    return spark.read.parquet(out).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@query("usage_totals", """
SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens,
  sum(CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN NULL
      ELSE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) + (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 2 END) END)
    AS combined FROM events GROUP BY event_type""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    log = b.table(spark, sf_dir, "events").select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        U.combined_usage(F.when(k % 3 != 0, 1), F.when(k % 2 != 0, 2)).alias("combined"),
    )
    return U.usage_totals(log, ["event_type"], ["tokens", "combined"])


@query("late_rows", """
SELECT event_id, event_id % 13 = 0 AS late FROM events""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive over ten minutes after their event time go to a side table."""
    main, late = fresh_dir(spark, "main"), fresh_dir(spark, "late")
    rows = table_stream(spark, sf_dir, "events").select("event_id", "ts", (
        F.col("ts") + F.when(F.col("event_id") % 13 == 0, F.expr("interval 11 minutes"))
        .otherwise(F.expr("interval 9 minutes"))
    ).alias("arrival"))
    run_to_end(U.late_side_sink(
        rows, "ts", "arrival", "10 minutes", main, late, fresh_dir(spark, "ckpt")
    ))
    return spark.read.parquet(main).select("event_id", F.lit(False).alias("late")).unionByName(
        spark.read.parquet(late).select("event_id", F.lit(True).alias("late"))
    )


@query("submission_plan", """
SELECT 'source-pdfs/corpus/p' || doc_id || CASE WHEN doc_id % 8 = 1 THEN ' x' ELSE '' END || '.pdf' AS key,
  CASE WHEN doc_id % 8 = 1 THEN 'invalid' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip'
       ELSE 'submit' END AS action FROM documents""")
def submission_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("p"), d, F.when(d % 8 == 1, " x").otherwise(""), F.lit(".pdf"))
    staged = b.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("source-pdfs/corpus/p"), d, F.lit(".pdf")).alias("key")
    )
    return J.plan_submissions(
        b.table(spark, sf_dir, "documents").select(name.alias("name")), "corpus", staged
    ).select("key", "action")


@query("submission_counts", """
SELECT CASE WHEN doc_id % 8 = 1 THEN 'invalid' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip'
  ELSE 'submit' END AS action, count(*) AS n FROM documents GROUP BY 1""")
def submission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.outcome_counts(submission_plan(spark, sf_dir))


INDEX_SCHEMA = [
    {"key": "year", "label": "Year", "type": "integer", "operators": ["eq", "gte", "lte"],
     "exposed": True, "source": "chunk.year"},
    {"key": "topic", "label": "Topic", "type": "string", "operators": ["eq"],
     "exposed": True, "source": "chunk.topic"},
]


def build_index(spark: SparkSession, sf_dir: str, root: str, rounds: int = 1) -> None:
    papers, _ = CH.parse_content_lists(bracket_papers(spark, sf_dir))
    written = fresh_dir(spark, "chunks")
    CH.chunk_papers(papers, "cambridge", "cam").write.option("compression", "zstd").parquet(written)
    chunks = spark.read.parquet(written)
    for _ in range(rounds):
        IX.index_chunks(chunks, "corpus", INDEX_SCHEMA, hashing_embedder(64), "hash-64", 64, root)
    discard(spark, written)


@query("index_and_reindex", """
SELECT CAST(doc_id % 25 + 2000 AS INTEGER) AS year, sum(1 + least((n + 2) // 3, 26)) AS chunks
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1""")
def index_and_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed and upsert all papers twice: the second run changes nothing."""
    root = fresh_dir(spark, "index")
    build_index(spark, sf_dir, root, rounds=2)
    return spark.read.parquet(f"{root}/vectors").groupBy("year").agg(
        F.count(F.lit(1)).alias("chunks")
    )


# Item ids of the second pass are 3,000,000 higher in the SQL.
STUDY_SQL = """WITH RECURSIVE asked AS (SELECT item_id, text FROM benchmark UNION ALL
  SELECT 3000000 + item_id, array_to_string(regexp_extract_all('more ' || text, '\\S+')[1:40], ' ') FROM benchmark),
""" + b.CTE["ch"] + ",\n" + b.CTE["tok"].replace("FROM benchmark", "FROM asked") + ",\n" + RANKED_SQL.replace("WHERE score >= 0.25", "") + """,
plans AS (SELECT item_id AS k, 'q' || item_id AS rid, 'q' || (3000000 + item_id) AS again,
    len(regexp_extract_all(text, '\\S+')) BETWEEN 1 AND 40 AS planned FROM benchmark),
routed AS (SELECT *, planned AND k % 6 = 5 AS direct FROM plans),
seen AS (SELECT query_id, count(*) AS n, list(chunk_id ORDER BY rank) AS ids FROM results GROUP BY 1),
passes AS (SELECT p.*, a.n AS n1, b.n AS n2, a.ids[1] AS t1, coalesce(a.ids[3], a.ids[1]) AS t3,
    CASE WHEN direct OR a.n IS NULL THEN NULL WHEN k % 7 = 3 THEN 'keep_all' WHEN k % 4 = 0 THEN 'requery' ELSE 'keep' END AS d1,
    len([x FOR x IN b.ids IF NOT list_contains(a.ids, x)]) AS fresh
  FROM routed p LEFT JOIN seen a ON a.query_id = p.rid LEFT JOIN seen b ON b.query_id = p.again),
decided AS (SELECT *, CASE WHEN direct THEN 'direct' WHEN d1 IS NULL THEN 'empty' WHEN d1 <> 'requery' THEN d1
    WHEN n2 IS NULL THEN 'empty' WHEN fresh = 0 OR k % 8 = 0 THEN 'abstain' ELSE 'keep_second' END AS decision FROM passes),
runs AS (SELECT d.rid AS query_id, r.rank, r.chunk_id, r.score, r.chunk_level, r.parent_chunk_id, r.text FROM decided d
  JOIN results r ON r.query_id = CASE WHEN d.decision = 'keep_second' THEN d.again ELSE d.rid END
  WHERE d.decision IN ('keep_all', 'keep_second') OR (d.decision = 'keep' AND r.rank <> 2)),
removed AS (SELECT DISTINCT s.query_id, CASE WHEN s.score > p.score THEN p.chunk_id ELSE s.chunk_id END AS chunk_id
  FROM runs s JOIN runs p ON p.query_id = s.query_id AND p.chunk_id = s.parent_chunk_id WHERE s.chunk_level = 'sub_question'),
remaining AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id, text FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM removed x WHERE x.query_id = r.query_id AND x.chunk_id = r.chunk_id)),
""" + PACK_SQL.replace("FROM results)", "FROM remaining)") + """,
context AS (SELECT t.query_id, list(t.chunk_id ORDER BY t.rank) AS ctx FROM tokens t
  JOIN fold f ON f.query_id = t.query_id AND f.rank = t.rank AND f.packed GROUP BY 1),
cited AS (SELECT d.*, c.ctx, CASE k % 5 WHEN 0 THEN [t1, t1] WHEN 1 THEN [t1, 'x0'] WHEN 2 THEN ['x0', 'x1'] WHEN 3 THEN [t1, t3] END AS cites
  FROM decided d LEFT JOIN context c ON c.query_id = d.rid),
resolved AS (SELECT *, [x FOR x IN cites IF list_contains(ctx, x)] AS kept, decision IN ('keep', 'keep_all', 'keep_second') AS shown FROM cited),
judged AS (SELECT *, CASE WHEN NOT shown THEN NULL WHEN cites IS NULL THEN 'schema_validation_failed'
    WHEN len(kept) = 0 THEN 'citation_validation_cascade_failure' END AS error FROM resolved)
SELECT rid AS request_id, CASE WHEN direct THEN 'out_of_scope' ELSE 'content_retrieval' END AS intent,
  CASE WHEN planned THEN 'ok' ELSE 'fallback' END AS planning_status,
  CASE WHEN direct THEN 'no_corpus_answer' WHEN NOT shown THEN 'insufficient_evidence' WHEN error IS NOT NULL THEN 'generation_failed'
    WHEN len(kept) < len(cites) THEN 'partial' ELSE 'ok' END AS answer_status,
  CASE decision WHEN 'direct' THEN 'skipped' WHEN 'empty' THEN 'empty' WHEN 'abstain' THEN 'low_relevance' ELSE 'ok' END AS retrieval_status,
  CASE WHEN NOT shown THEN 0 WHEN decision = 'keep_second' THEN n2 ELSE n1 END AS returned_result_count,
  coalesce(d1 = 'requery', FALSE) AS requery_attempted,
  CASE WHEN shown AND cites IS NOT NULL THEN len(cites) - len(kept) ELSE 0 END AS citation_drops, error AS error_category,
  CASE WHEN decision = 'abstain' THEN 'reflection_abstained' WHEN direct THEN 'no_corpus_answer' ELSE coalesce(error, 'ok') END AS outcome,
  CASE WHEN shown THEN array_to_string(ctx, ',') ELSE '' END AS context_ids,
  CASE WHEN NOT shown THEN '' WHEN error IS NOT NULL THEN array_to_string(ctx, ',')
    WHEN kept[1] = kept[2] THEN kept[1] ELSE array_to_string(kept, ',') END AS source_ids FROM judged"""


@query("study_answers", STUDY_SQL)
def study_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study job: plans, search, grades, one requery, packing, citations. Graders and
    drafts work on the request's own results: a grader fails, rejects all or leaves out the second
    one; a draft cites own results, an id with a suffix, ids that nobody was shown, or is missing."""
    k = F.col("item_id")
    items = b.table(spark, sf_dir, "benchmark")
    rid = F.concat(F.lit("q"), k).alias("request_id")
    requests = items.select(
        rid, F.col("text").alias("query"), b.corpus_of("item_id"),
        b.no_filters().alias("filters"), F.lit(15).alias("top_k"),
    )
    plans = items.select(rid, F.to_json(F.struct(
        F.array("text").alias("semantic_queries"),
        F.when(k % 6 == 5, "out_of_scope").otherwise("content_retrieval").alias("intent"),
    )).alias("plan_json"), F.lit(None).cast("string").alias("plan_error"))
    more = F.concat(F.lit("more "), F.col("text"))
    again = items.select(rid, more.alias("reformulated_query"))
    embed = hashing_embedder(64)
    vectors = b.text_vectors(spark, sf_dir)
    stored = b.stored_chunks(spark, sf_dir)

    def searcher(queries: DataFrame) -> DataFrame:
        return S.search(
            queries.withColumn("vector", embed("query")), vectors, stored, None, lexical_overlap
        )

    def asked(n: int, query: Column) -> DataFrame:
        return items.select(F.concat(F.lit(f"{n}q"), k).alias("query_id"), query.alias("query"), b.corpus_of("item_id"),
                            b.no_filters().alias("filters"), F.lit(15).alias("limit"), F.lit(True).alias("rerank"))

    both = asked(1, F.col("text")).unionByName(asked(2, ST.check_reformulation(more, F.col("text"))))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    found = materialise(searcher(both.where("query IS NOT NULL")).groupBy("query_id").agg(ids.alias("ids")).select(
        F.substr("query_id", F.lit(2)).alias("request_id"), F.substr("query_id", F.lit(1), F.lit(1)).cast("int").alias("pass"),
        F.substr("query_id", F.lit(3)).cast("bigint").alias("k"), "ids"), "grades")
    n = F.col("k")
    none = F.array().cast("array<string>")
    accepted = F.when(F.col("pass") == 1, F.when(n % 4 == 0, none).otherwise(F.array_except("ids", F.slice("ids", 2, 1)))).otherwise(
        F.when(n % 8 == 0, none).otherwise(F.col("ids")))
    grades = found.select("request_id", "pass", F.when(n % 7 != 3, F.to_json(F.struct(
        accepted.alias("accepted_chunk_ids"), F.lit("").alias("critique")))).alias("grade_json"))
    first, third = F.get("ids", F.lit(0)), F.coalesce(F.get("ids", F.lit(2)), F.get("ids", F.lit(0)))
    support = (F.when(n % 5 == 1, F.array(F.concat(first, F.lit("(a)")), F.lit("x0"))).when(n % 5 == 2, F.array(F.lit("x0"), F.lit("x1")))
               .otherwise(F.array(first)))
    sources = F.when(n % 5 == 0, F.array(first)).when(n % 5 == 3, F.array(third)).otherwise(none)
    drafts = found.where("pass = 1").select("request_id", F.when(n % 5 != 4, F.to_json(F.struct(
        F.lit("ok").alias("answer_status"), F.lit("found").alias("overview"),
        F.array(F.struct(F.lit("a").alias("label"), F.lit("b").alias("summary"), support.alias("supporting_chunk_ids"))).alias("patterns"),
        F.transform(sources, lambda c: F.struct(c.alias("chunk_id"), F.lit("why").alias("why_cited"))).alias("cited_sources"),
        none.alias("limitations"),
    ))).alias("draft_json"))
    out = ST.study(requests, plans, searcher, grades, again, drafts, 1000, 400)
    return out.select(
        "request_id", "intent", "planning_status", "answer_status", "retrieval_status",
        "returned_result_count", "requery_attempted", "citation_drops", "error_category", "outcome",
        F.array_join("context_chunk_ids", ",").alias("context_ids"),
        F.array_join("source_ids", ",").alias("source_ids"),
    )
