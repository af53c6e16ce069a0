"""Queries over vectors, filters and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.bridge import SCHEMA, with_ctes
from paperfold.catalog.registry import query
from paperfold.functions import metadata as M
from paperfold.functions.providers import hashing_embedder, lexical_overlap
from paperfold.operators import filters as FL
from paperfold.operators import vector_search as V
from paperfold.plans import search as S

ROUND = 6


@query("cosine_topk_one_query", with_ctes("ch", "cent", body="""
SELECT s.chunk_id, d.source, round(s.score, 6) AS score
FROM (SELECT ch.chunk_id, ch.doc_id,
             round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vector), 12) AS score
      FROM ch JOIN embeddings e ON e.vec_id = ch.doc_id, cent c
      WHERE c.label = 0 AND ch.lang = 'en'
      ORDER BY score DESC, chunk_id LIMIT 10) s
JOIN documents d ON d.doc_id = s.doc_id"""))
def cosine_topk_one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = b.topic_queries(spark, sf_dir).filter("label = 0").first()["vector"]
    chunks = b.vectors(spark, sf_dir)
    top = V.top_k_single(chunks, vector, 10, FL.filter_column(
        [{"field": "lang", "op": "eq", "value": "en"}], promoted=("lang",)
    ))
    named = b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "source"
    )
    return top.join(named, "chunk_id").select("chunk_id", "source", F.round("score", ROUND).alias("score"))


@query("cosine_topk_topic_queries", with_ctes("ch", "cent", body="""
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT 't' || c.label AS query_id, ch.chunk_id,
           round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vector), 12) AS score
    FROM ch JOIN embeddings e ON e.vec_id = ch.doc_id CROSS JOIN cent c))
WHERE rank <= 10"""))
def cosine_topk_topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = b.topic_queries(spark, sf_dir).select(
        "query_id", b.corpus_of("label"), "vector", F.lit(10).alias("k"),
        F.lit("[]").alias("filters"),
    )
    top = V.top_k_batch(b.vectors(spark, sf_dir), queries)
    return top.select("query_id", F.col("vec_rank").alias("rank"), "chunk_id",
                      F.round("score", ROUND).alias("score"))


@query("nearest_of_every_vector", with_ctes("ch", body="""
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT 'v' || q.vec_id AS query_id, 'd' || e.vec_id AS chunk_id,
           round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12)
             AS score
    FROM embeddings q JOIN embeddings e ON q.label = e.label))
WHERE rank <= 3"""))
def nearest_of_every_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a query inside its own topic (topic = collection)."""
    emb = b.table(spark, sf_dir, "embeddings")
    topic = F.concat(F.lit("t"), F.col("label"))
    stored = emb.select(
        topic.alias("collection"), F.concat(F.lit("d"), F.col("vec_id")).alias("chunk_id"),
        "embedding",
    )
    queries = emb.select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("query_id"), topic.alias("collection"),
        F.col("embedding").alias("vector"), F.lit(3).alias("k"), F.lit("[]").alias("filters"),
    )
    top = V.top_k_batch(stored, queries)
    return top.select("query_id", F.col("vec_rank").alias("rank"), "chunk_id",
                      F.round("score", ROUND).alias("score"))


@query("search_mixed_filters", with_ctes("ch", "cent", body="""
SELECT query_id, rank, chunk_id, chunk_level, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT 't' || c.label AS query_id, ch.chunk_id, ch.chunk_level,
           round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vector), 12) AS score
    FROM ch JOIN embeddings e ON e.vec_id = ch.doc_id CROSS JOIN cent c
    WHERE CASE c.label % 4
            WHEN 0 THEN ch.lang = 'en' AND ch.n_chars >= 500
            WHEN 1 THEN ch.chunk_level = 'question' AND ch.year <= 2012
            WHEN 2 THEN ch.toxic = FALSE
            ELSE TRUE END))
WHERE rank <= 8"""))
def search_mixed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query has its own filters; all are answered in one pass over the vectors."""
    kind = F.col("label") % 4
    filters = (
        F.when(kind == 0, F.array(
            b.condition("lang", "eq", "en", "string"),
            b.condition("n_chars", "gte", 500, "integer")))
        .when(kind == 1, F.array(
            b.condition("chunk_level", "eq", "question", "string"),
            b.condition("year", "lte", 2012, "integer")))
        .when(kind == 2, F.array(b.condition("toxic", "eq", "false", "boolean")))
        .otherwise(b.no_filters())
    )
    queries = b.topic_queries(spark, sf_dir).select(
        "query_id", F.col("query_id").alias("query"), b.corpus_of("label"),
        "vector", filters.alias("filters"), F.lit(8).alias("limit"), F.lit(False).alias("rerank"),
    )
    out = S.search(queries, b.vectors(spark, sf_dir), b.chunks(spark, sf_dir))
    return out.select("query_id", "rank", "chunk_id", "chunk_level",
                      F.round("score", ROUND).alias("score"))


RANKED_SQL = """dots AS (SELECT q.id AS query_id, d.id AS chunk_id,
    round(sum(q.n * d.n) / (any_value(nq.norm) * any_value(nd.norm)), 12) AS vscore
  FROM slots q JOIN slots d ON d.s = q.s AND q.id LIKE 'q%' AND d.id LIKE 'd%'
  JOIN norms nq ON nq.id = q.id JOIN norms nd ON nd.id = d.id GROUP BY q.id, d.id),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY vscore DESC, chunk_id) AS vrank FROM dots) WHERE vrank <= 45),
dtok AS (SELECT id, list(DISTINCT t) AS ts FROM toks GROUP BY id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vrank) AS rank
  FROM (SELECT v.*, len(list_intersect(q.ts, d.ts)) / greatest(len(q.ts), 1) AS score
        FROM vtop v JOIN dtok q ON q.id = v.query_id JOIN dtok d ON d.id = v.chunk_id)
  WHERE score >= 0.25),
results AS (SELECT r.query_id, r.rank, r.chunk_id, r.score, ch.chunk_level, ch.parent_chunk_id,
    ch.text, ch.topic, ch.year, ch.lang, ch.n_chars, ch.toxic
  FROM ranked r JOIN ch ON ch.chunk_id = r.chunk_id WHERE r.rank <= 15)"""


def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark texts searched over all documents: embed, top-k, rerank, threshold."""
    thresholds = spark.createDataFrame(
        [("corpus", None, 0.25)],
        "name string, vector_min_score double, rerank_min_score double",
    )
    return S.search(
        b.text_queries(spark, sf_dir, 15, True), b.text_vectors(spark, sf_dir),
        b.stored_chunks(spark, sf_dir), thresholds, lexical_overlap,
    )


@query("search_rerank_threshold", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT query_id, rank, chunk_id, chunk_level, round(score, 6) AS score FROM results"""))
def search_rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_results(spark, sf_dir).select(
        "query_id", "rank", "chunk_id", "chunk_level", F.round("score", ROUND).alias("score")
    )


@query("search_totals", with_ctes("ch", "tok", then=RANKED_SQL, body="""
SELECT 'q' || i.item_id AS query_id, count(r.chunk_id) AS total
FROM benchmark i LEFT JOIN results r ON r.query_id = 'q' || i.item_id GROUP BY i.item_id"""))
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.response_totals(
        b.text_queries(spark, sf_dir, 15, True), ranked_results(spark, sf_dir)
    )


@query("hash_embeddings", with_ctes("tok", body="""
SELECT id, count(*) AS used_slots, sum(n) AS tokens, sum(s * n) AS weighted
FROM slots GROUP BY id
UNION ALL SELECT id, 0, 0, 0 FROM texts WHERE id NOT IN (SELECT id FROM slots)"""))
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = hashing_embedder(64)
    texts = b.texts(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text"
    ).unionByName(b.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id")).alias("id"), "text"
    ))
    v = texts.select("id", embed("text").alias("v"))
    weighted = F.aggregate(
        F.transform("v", lambda x, i: x.cast("bigint") * i), F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return v.select(
        "id",
        F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("used_slots"),
        F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("tokens"),
        weighted.alias("weighted"),
    )


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> one saved condition each, some of them not allowed."""
    k = F.col("doc_id") % 6
    cond = (
        F.when(k == 0, b.condition("lang", "eq", F.col("lang"), "string"))
        .when(k == 1, b.condition("n_chars", "gte", F.col("n_chars"), "integer"))
        .when(k == 2, b.condition("lang", "gte", F.col("lang"), "string"))
        .when(k == 3, b.condition("owner", "eq", F.col("source"), "string"))
        .when(k == 4, b.condition("toxic", "eq", F.col("n_chars"), "integer"))
        .otherwise(b.condition("chunk_level", "lte", F.col("source"), "string"))
    )
    return b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), F.col("doc_id")).alias("query_id"),
        F.col("source").alias("collection"), F.array(cond).alias("filters"),
    )


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (collection, declared field)."""
    fields = F.array(*[
        F.struct(
            F.lit(f["key"]).alias("key"), F.lit(f["type"]).alias("type"),
            F.array(*[F.lit(o) for o in f["operators"]]).alias("operators"),
        ) for f in SCHEMA
    ])
    return b.collections(spark, sf_dir).select(
        F.col("name").alias("collection"), F.inline(fields)
    )


@query("filter_violations", """
SELECT 's' || doc_id AS query_id,
       CASE doc_id % 6 WHEN 2 THEN 'lang' WHEN 3 THEN 'owner' WHEN 4 THEN 'toxic'
            ELSE 'chunk_level' END AS field,
       CASE doc_id % 6 WHEN 2 THEN 'operator_not_allowed' WHEN 3 THEN 'unknown_field'
            WHEN 4 THEN 'wrong_value_type' ELSE 'operator_not_allowed' END AS reason
FROM documents WHERE doc_id % 6 >= 2""")
def filter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.filter_violations(saved_filters(spark, sf_dir), schema_fields(spark, sf_dir))


@query("filter_compiled", with_ctes("ch", body="""
SELECT chunk_id, source_pdf FROM ch
WHERE n_chars >= 400 AND year <= 2015 AND toxic = FALSE AND chunk_level = 'sub_question'"""))
def filter_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = FL.check_filters(
        FL.conditions_from_mapping({"toxic": False, "chunk_level": "sub_question", "topic": None})
        + [{"field": "n_chars", "op": "gte", "value": 400},
           {"field": "year", "op": "lte", "value": 2015}],
        SCHEMA,
    )
    return b.stored_chunks(spark, sf_dir).filter(FL.filter_column(wanted)).select(
        "chunk_id", "source_pdf"
    )


@query("filter_strings", """
SELECT doc_id,
  CASE k WHEN 0 THEN 'lang' WHEN 1 THEN 'n_chars' WHEN 5 THEN 'source' END AS field,
  CASE k WHEN 0 THEN 'eq' WHEN 1 THEN 'gte' WHEN 5 THEN 'eq' END AS op,
  CASE k WHEN 0 THEN lang WHEN 1 THEN CAST(n_chars AS VARCHAR) WHEN 5 THEN source || ':' || lang END
    AS value,
  CASE k WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 5 THEN 'string' END AS value_type,
  CASE k WHEN 2 THEN 'malformed' WHEN 3 THEN 'integer_required' WHEN 4 THEN 'empty_value' END
    AS error
FROM (SELECT *, doc_id % 6 AS k FROM documents)""")
def filter_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("lang:eq:"), "lang"))
        .when(k == 1, F.concat(F.lit("n_chars:gte:"), F.col("n_chars")))
        .when(k == 2, F.concat(F.lit("lang:"), "lang"))
        .when(k == 3, F.concat(F.lit("lang:gte:"), "lang"))
        .when(k == 4, F.lit("lang:eq:"))
        .otherwise(F.concat(F.lit("source:eq:"), "source", F.lit(":"), "lang"))
    )
    docs = b.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return FL.parse_filter_strings(docs, "raw").drop("raw")


URL_SQL = """
SELECT page_id,
  CASE k WHEN 0 THEN 'lang=en|n_chars>=' || page_id WHEN 6 THEN '' WHEN 7 THEN 'topic=a b:c%d' END
    AS conditions,
  CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'unknown_operator' WHEN 3 THEN 'unknown_field'
         WHEN 4 THEN 'empty_value' WHEN 5 THEN 'invalid_value_type' END AS reason
FROM (SELECT page_id, page_id % 8 AS k FROM pages)"""


@query("url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 8
    pid = F.col("page_id").cast("string")
    params = (
        F.when(k == 0, F.concat(F.lit("filter=lang:eq:en&x=1&filter=n_chars%3Agte%3A"), pid))
        .when(k == 1, F.concat(F.lit("filter=lang%3Aeq"), pid))
        .when(k == 2, F.concat(F.lit("filter=lang:gt:"), pid))
        .when(k == 3, F.concat(F.lit("filter=lang:eq:en&filter=owner:eq:"), pid))
        .when(k == 4, F.lit("filter=lang:eq:"))
        .when(k == 5, F.concat(F.lit("filter=toxic:eq:"), pid))
        .when(k == 6, F.concat(F.lit("page="), pid))
        .otherwise(F.lit("filter=topic%3Aeq%3Aa%2520b%253Ac%2525d"))
    )
    log = b.table(spark, sf_dir, "pages").select("page_id", F.concat(
        F.regexp_replace("url", r"[?#].*\z", ""), F.lit("?"), params, F.lit("#top")
    ).alias("url"))
    out = FL.parse_url_filters(log, "url", SCHEMA)
    shown = F.array_join(F.transform("conditions", lambda c: F.concat(
        c["field"],
        F.when(c["op"] == "eq", "=").when(c["op"] == "gte", ">=").otherwise("<="), c["value"],
    )), "|")
    return out.select("page_id", shown.alias("conditions"), "reason")


META_SQL = with_ctes("ch", body="""
SELECT chunk_id,
  concat_ws(' | ', 'Year: ' || year, 'Language: ' || lang, 'Length: ' || n_chars,
    'Toxic: ' || CAST(toxic AS VARCHAR), 'Topic: ' || topic) AS summary,
  concat_ws(' / ', CAST(year AS VARCHAR), lang, CAST(n_chars AS VARCHAR),
    CASE WHEN toxic THEN 'Yes' WHEN NOT toxic THEN 'No' END, topic) AS ui_summary,
  concat_ws(' / ', 'lang: ' || lang, 'n chars: ' || n_chars, 'quality: ' || quality,
    'topic: ' || topic, 'toxic: ' || CASE WHEN toxic THEN 'Yes' WHEN NOT toxic THEN 'No' END,
    'year: ' || year) AS ui_generic
FROM ch""")


@query("metadata_summaries", META_SQL)
def metadata_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.stored_chunks(spark, sf_dir).select(
        "chunk_id",
        M.metadata_summary(SCHEMA, "metadata").alias("summary"),
        M.ui_summary(SCHEMA, "metadata").alias("ui_summary"),
        M.ui_summary(None, "metadata").alias("ui_generic"),
    )


@query("metadata_projection", with_ctes("ch", body="""
SELECT chunk_id,
  '{"year":' || year || ',"lang":"' || lang || '"' ||
    CASE WHEN topic IS NOT NULL THEN ',"topic":"' || topic || '"' ELSE '' END || '}' AS projected,
  '{"lang":"' || lang || '"' ||
    CASE WHEN toxic IS NOT NULL THEN ',"toxic":' || CAST(toxic AS VARCHAR) ELSE '' END || '}'
    AS shown
FROM ch"""))
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk columns -> stored metadata, and stored metadata -> declared result keys."""
    df = b.stored_chunks(spark, sf_dir)
    rows = df.withColumnRenamed("metadata", "stored").withColumn(
        "metadata", F.create_map(F.lit("lang"), F.col("lang"))
    )
    narrow = [f for f in SCHEMA if f["key"] in ("lang", "toxic")]
    return rows.select(
        "chunk_id", M.project_chunk_metadata(SCHEMA).alias("projected"),
        M.project_result_metadata(narrow, "stored").alias("shown"),
    )


@query("flat_json_cutover", with_ctes("ch", body="""
SELECT chunk_id, year, topic, coalesce(toxic, FALSE) AS toxic, quality FROM ch"""))
def flat_json_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = b.chunks(spark, sf_dir).select(
        "chunk_id", M.flat_to_json(["year", "topic", "toxic", "quality"]).alias("metadata")
    )
    return flat.select("chunk_id", *M.json_to_flat("metadata", {
        "year": "integer", "topic": "string", "toxic": "boolean", "quality": "integer",
    }))


@query("embedding_texts", with_ctes("ch", body="""
SELECT chunk_id, md5(trim(text, chr(9) || chr(10) || chr(13) || ' ') || chr(10) || chr(10) ||
  concat_ws(' | ', 'Year: ' || year, 'Language: ' || lang, 'Length: ' || n_chars,
    'Toxic: ' || CAST(toxic AS VARCHAR), 'Topic: ' || topic)) AS digest FROM ch"""))
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.stored_chunks(spark, sf_dir).select("chunk_id", F.md5(M.embedding_text(
        F.col("text"), M.metadata_summary(SCHEMA, "metadata")
    )).alias("digest"))


@query("request_limits", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'query_too_long'
  WHEN doc_id % 70 = 0 THEN 'limit_not_positive'
  WHEN doc_id % 70 > 20 AND doc_id % 2 = 0 THEN 'top_k_too_large'
  WHEN doc_id % 70 > 50 THEN 'limit_too_large' END AS reason
FROM documents""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", FL.request_reject_reason(
        F.col("text"), F.col("doc_id") % 70, F.lit(True), F.col("doc_id") % 2 == 0
    ).alias("reason"))


@query("chunk_lookup", with_ctes("ch", body="""
SELECT l.l_orderkey, l.l_linenumber,
  CASE WHEN l.l_orderkey % 5 = 0 THEN 'collection_not_found'
       WHEN c.chunk_id IS NULL THEN 'chunk_not_found' ELSE 'ok' END AS status,
  c.chunk_level, md5(p.text) AS parent_digest
FROM lineitem l
LEFT JOIN ch c ON c.chunk_id = 'd' || l.l_partkey AND l.l_orderkey % 5 <> 0
LEFT JOIN ch p ON p.chunk_id = c.parent_chunk_id"""))
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 5 == 0, "elsewhere").otherwise("corpus").alias("collection"),
        F.concat(F.lit("d"), F.col("l_partkey")).alias("chunk_id"),
    )
    stored = b.chunks(spark, sf_dir)
    known = stored.select(F.col("collection").alias("name")).distinct()
    return S.chunk_lookup(keys, stored, known).select(
        "l_orderkey", "l_linenumber", "status", "chunk_level",
        F.md5("parent_text").alias("parent_digest"),
    )


@query("chunk_inspection", with_ctes("ch", body="""
SELECT chunk_id, year FROM ch
WHERE chunk_level = 'question' AND (year BETWEEN 2003 AND 2008 OR year = 2020)"""))
def chunk_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FL.select_years(b.chunks(spark, sf_dir), "2003-2008, 2020")
    return FL.filter_chunks(rows, chunk_level="question", source_pdf=None).select(
        "chunk_id", "year"
    )


@query("search_rejects", """
SELECT 't' || label AS query_id,
  CASE label % 7 WHEN 1 THEN 'limit_too_large' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'wrong_value_type'
    WHEN 4 THEN 'collection_not_found' WHEN 5 THEN 'dimension_mismatch' END AS reason,
  CASE WHEN label % 7 IN (0, 6) THEN 5 ELSE 0 END AS found, 0 AS old_generation
FROM (SELECT DISTINCT label FROM embeddings)""")
def search_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad queries in one batch: the bad come back with a reason, the good run, over
    the vectors of the collection's current model only."""
    kind = F.col("label") % 7
    filters = (
        F.when(kind == 2, F.array(b.condition("owner", "eq", "x", "string")))
        .when(kind == 3, F.array(b.condition("year", "eq", "x", "string")))
        .otherwise(b.no_filters())
    )
    queries = b.topic_queries(spark, sf_dir).select(
        "query_id", F.col("query_id").alias("query"),
        F.when(kind == 4, "nowhere").otherwise("corpus").alias("collection"),
        F.when(kind == 5, F.slice("vector", 1, 8)).otherwise(F.col("vector")).alias("vector"),
        filters.alias("filters"), F.when(kind == 1, 51).otherwise(5).alias("limit"), F.lit(False).alias("rerank"),
    )
    old = F.col("chunk_id").endswith("0")
    vectors = b.vectors(spark, sf_dir).withColumn("embedding_model_id", F.when(old, "m1").otherwise("m2"))
    emb = b.table(spark, sf_dir, "embeddings")
    collections = emb.agg(F.max(F.size("embedding")).alias("embedding_dimension")).select(
        F.lit("corpus").alias("name"), "embedding_dimension", F.lit("m2").alias("embedding_model_id"),
        F.lit(None).cast("double").alias("vector_min_score"), F.lit(None).cast("double").alias("rerank_min_score"))
    fields = schema_fields(spark, sf_dir).drop("collection").distinct().withColumn("collection", F.lit("corpus"))
    results, rejects = S.search_checked(queries, vectors, b.chunks(spark, sf_dir), fields, collections)
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(old).alias("old_generation"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return queries.select("query_id").join(rejects, "query_id", "left").join(counts, "query_id", "left").select(
        "query_id", "reason", zero("found"), zero("old_generation"))
