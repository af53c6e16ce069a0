"""Driver tables seen as corpus tables, in Spark and (as CTEs) in SQL.

documents = chunks (two of three are sub-questions of the third), documents.source =
collection, (source, lang) = paper, embeddings = chunk vectors, embeddings.label =
topic, benchmark = query texts, nation/customer/orders = communities, users and
memberships, events = requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.functions.providers import hashing_embedder
from paperfold.session import small_batches, spread

SCHEMA = [
    {"key": "year", "label": "Year", "type": "integer", "operators": ["eq", "gte", "lte"],
     "exposed": True, "source": "chunk.year"},
    {"key": "lang", "label": "Language", "type": "string", "operators": ["eq"],
     "exposed": True, "source": "chunk.metadata.lang"},
    {"key": "n_chars", "label": "Length", "type": "integer", "operators": ["eq", "gte", "lte"],
     "exposed": True, "source": None},
    {"key": "quality", "label": "Quality", "type": "integer", "operators": ["eq"],
     "exposed": False, "source": None},
    {"key": "toxic", "label": "Toxic", "type": "boolean", "operators": ["eq"],
     "exposed": True, "source": None},
    {"key": "topic", "label": "Topic", "type": "string", "operators": ["eq"],
     "exposed": True, "source": "chunk.topic"},
]

# One CTE per bridge table; a query's SQL picks those it needs.
CTE = {
    "ch": """ch AS (
  SELECT 'corpus' AS collection, d.source AS source, d.doc_id,
         'd' || d.doc_id AS chunk_id,
         CASE WHEN d.doc_id % 3 = 0 THEN 'question' ELSE 'sub_question' END AS chunk_level,
         CASE WHEN d.doc_id % 3 <> 0 THEN 'd' || (d.doc_id - d.doc_id % 3) END AS parent_chunk_id,
         d.text, d.source || '-' || d.lang || '.pdf' AS source_pdf,
         CAST(2000 + d.doc_id % 25 AS INTEGER) AS year, d.lang,
         CAST(d.n_chars AS INTEGER) AS n_chars, l.quality,
         CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 1 END AS toxic,
         CASE WHEN e.label IS NOT NULL THEN 't' || e.label END AS topic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "cent": """parts AS (
  SELECT label, i AS pos, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i
        FROM embeddings)),
cent AS (SELECT label, list(a ORDER BY pos) AS vector
         FROM (SELECT label, pos, avg(v) AS a FROM parts GROUP BY label, pos) GROUP BY label)""",
    "tok": """texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'q' || item_id, text FROM benchmark),
toks AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM texts),
slots AS (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS s, count(*) AS n
          FROM toks GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM slots GROUP BY id)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table, spread over the cores for per-text work."""
    small_batches(spark)
    return spread(table(spark, sf_dir, name))


def corpus_of(key: str):
    """The collection of a row. Not a bare literal: joins on it stay equi joins."""
    return F.when(F.col(key).isNotNull(), "corpus").alias("collection")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels and topic, as a flat chunk table."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    topics = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.concat(F.lit("t"), F.col("label")).alias("topic")
    )
    part = F.col("doc_id") % 3
    return d.join(labels, "doc_id", "left").join(topics, "doc_id", "left").select(
        corpus_of("doc_id"), "source", "doc_id",
        F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"),
        F.when(part == 0, "question").otherwise("sub_question").alias("chunk_level"),
        F.when(part != 0, F.concat(F.lit("d"), F.col("doc_id") - part)).alias("parent_chunk_id"),
        "text",
        F.concat("source", F.lit("-"), "lang", F.lit(".pdf")).alias("source_pdf"),
        (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"),
        "lang", F.col("n_chars").cast("int").alias("n_chars"), "quality",
        F.when(F.col("toxic").isNotNull(), F.col("toxic") == 1).alias("toxic"),
        "topic",
    )


def with_metadata(df: DataFrame) -> DataFrame:
    """Adds the metadata JSON document (null members left out)."""
    return df.withColumn("metadata", F.to_json(F.struct(*[f["key"] for f in SCHEMA])))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metadata(chunks(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector table: chunk vectors with typed filter columns."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    return chunks(spark, sf_dir).drop("text").join(emb, "doc_id")


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per topic: the mean of its vectors (partial sums per dimension)."""
    emb = table(spark, sf_dir, "embeddings")
    parts = emb.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("a"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]
    ).alias("vector")).select(
        F.concat(F.lit("t"), F.col("label")).alias("query_id"), "label", "vector"
    )


def no_filters():
    return F.array().cast("array<struct<field:string,op:string,value:string,value_type:string>>")


def condition(field: str, op: str, value, kind: str):
    text = value if not isinstance(value, (str, int)) else F.lit(str(value))
    return F.struct(
        F.lit(field).alias("field"), F.lit(op).alias("op"),
        text.cast("string").alias("value"), F.lit(kind).alias("value_type"),
    )


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded from their whole text by the default embedder."""
    embed = hashing_embedder(64)
    embedded = texts(spark, sf_dir).select("doc_id", embed("text").alias("embedding"))
    return chunks(spark, sf_dir).drop("text").join(embedded, "doc_id")


def text_queries(spark: SparkSession, sf_dir: str, limit: int, rerank: bool) -> DataFrame:
    """benchmark texts as queries, embedded the same way."""
    embed = hashing_embedder(64)
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id")).alias("query_id"),
        F.col("text").alias("query"), corpus_of("item_id"),
        embed("text").alias("vector"), no_filters().alias("filters"),
        F.lit(limit).alias("limit"), F.lit(rerank).alias("rerank"),
    )


# --- access side ---------------------------------------------------------------

CTE["acc"] = """communities AS (
  SELECT 'c' || n_nationkey AS id, n_name AS name FROM nation),
rules AS (
  SELECT 'c' || n_nationkey AS community_id, lower(n_name) || '.edu' AS domain,
         CASE WHEN n_nationkey % 2 = 0 THEN 'suffix' ELSE 'exact' END AS match_mode,
         n_nationkey % 5 <> 4 AS is_active FROM nation
  UNION ALL
  SELECT 'c' || ((n_nationkey + 1) % 25), 'cs.' || lower(n_name) || '.edu', 'exact', TRUE
  FROM nation WHERE n_nationkey % 3 = 0),
users AS (
  SELECT 'u' || c_custkey AS id, 'u' || c_custkey || '@' ||
         CASE c_custkey % 3 WHEN 0 THEN 'cs.' || lower(n_name) || '.edu'
              WHEN 1 THEN lower(n_name) || '.edu' ELSE 'mail.org' END AS email
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
overrides AS (
  SELECT 'u' || c_custkey || '@mail.org' AS email, 'c' || (c_custkey % 25) AS community_id,
         c_acctbal > 0 AS is_active,
         CASE WHEN c_custkey % 2 = 0 THEN NULL
              WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2020-01-01'
              ELSE TIMESTAMP '2030-01-01' END AS expires_at
  FROM customer WHERE c_custkey % 3 = 2 AND c_mktsegment = 'BUILDING'),
memberships AS (
  SELECT 'u' || o_custkey AS user_id, 'c' || (o_custkey % 25) AS community_id,
         CASE WHEN bool_or(o_orderstatus = 'F') THEN 'active' ELSE 'inactive' END AS status
  FROM orders GROUP BY o_custkey),
colls AS (
  SELECT source AS name,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 4 = 0 THEN NULL
              ELSE 'c' || (CAST(substr(source, 4) AS INTEGER)) END AS community_id
  FROM (SELECT DISTINCT source FROM documents)),
aff AS (
  SELECT u.email,
         coalesce(o.community_id, CASE WHEN m.lo = m.hi THEN m.lo END) AS community_id,
         CASE WHEN o.community_id IS NOT NULL THEN NULL
              WHEN m.lo IS NULL THEN 'unsupported_email_domain'
              WHEN m.lo <> m.hi THEN 'ambiguous_email_domain' END AS deny_reason
  FROM (SELECT DISTINCT email FROM users) u
  LEFT JOIN (SELECT * FROM overrides WHERE is_active AND
             (expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01')) o ON o.email = u.email
  LEFT JOIN (SELECT us.email, min(r.community_id) AS lo, max(r.community_id) AS hi
             FROM users us JOIN rules r ON r.is_active AND (
               split_part(us.email, '@', 2) = r.domain OR
               (r.match_mode = 'suffix' AND ends_with(split_part(us.email, '@', 2), '.' || r.domain)))
             GROUP BY us.email) m ON m.email = u.email),
reqs AS (
  SELECT e.event_id, CASE WHEN e.event_type <> 'error' THEN 'u' || e.user_id END AS user_id,
         'src' || (e.event_id % 20) AS collection
  FROM events e),
reqaff AS (
  SELECT r.*, CASE WHEN r.user_id IS NOT NULL THEN a.community_id END AS affiliation
  FROM reqs r LEFT JOIN users u ON u.id = r.user_id LEFT JOIN aff a ON a.email = u.email),
states AS (
  SELECT r.event_id, r.user_id, r.collection,
    CASE WHEN c.community_id IS NULL THEN 'accessible'
         WHEN r.user_id IS NULL THEN 'locked_requires_signin'
         WHEN r.affiliation IS NOT NULL AND r.affiliation <> c.community_id
           THEN 'locked_wrong_affiliation'
         WHEN m.user_id IS NOT NULL THEN 'accessible'
         ELSE 'locked_wrong_affiliation' END AS access_state,
    co.name AS community_name
  FROM reqaff r JOIN colls c ON c.name = r.collection
  LEFT JOIN communities co ON co.id = c.community_id
  LEFT JOIN (SELECT DISTINCT user_id, community_id FROM memberships WHERE status = 'active') m
    ON m.user_id = r.user_id AND m.community_id = c.community_id)"""


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("c"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")
    )


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    own = n.select(
        F.concat(F.lit("c"), k).alias("community_id"),
        F.concat(F.lower("n_name"), F.lit(".edu")).alias("domain"),
        F.when(k % 2 == 0, "suffix").otherwise("exact").alias("match_mode"),
        (k % 5 != 4).alias("is_active"),
    )
    shared = n.filter(k % 3 == 0).select(
        F.concat(F.lit("c"), (k + 1) % 25).alias("community_id"),
        F.concat(F.lit("cs."), F.lower("n_name"), F.lit(".edu")).alias("domain"),
        F.lit("exact").alias("match_mode"), F.lit(True).alias("is_active"),
    )
    return own.unionByName(shared)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("c_custkey")
    uid = F.concat(F.lit("u"), k)
    domain = (
        F.when(k % 3 == 0, F.concat(F.lit("cs."), F.lower("n_name"), F.lit(".edu")))
        .when(k % 3 == 1, F.concat(F.lower("n_name"), F.lit(".edu")))
        .otherwise("mail.org")
    )
    return c.select(uid.alias("id"), F.concat(uid, F.lit("@"), domain).alias("email"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(
        (k % 3 == 2) & (F.col("c_mktsegment") == "BUILDING")
    ).select(
        F.concat(F.lit("u"), k, F.lit("@mail.org")).alias("email"),
        F.concat(F.lit("c"), k % 25).alias("community_id"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(k % 2 == 0, F.lit(None).cast("timestamp"))
        .when(k % 7 == 0, F.lit("2020-01-01").cast("timestamp"))
        .otherwise(F.lit("2030-01-01").cast("timestamp")).alias("expires_at"),
    )


def as_of():
    return F.lit("2024-06-01").cast("timestamp")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("f")
    ).select(
        F.concat(F.lit("u"), k).alias("user_id"), F.concat(F.lit("c"), k % 25).alias("community_id"),
        F.lit("member").alias("role"),
        F.when(F.col("f"), "active").otherwise("inactive").alias("status"),
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("name"),
        F.when(n % 4 != 0, F.concat(F.lit("c"), n)).alias("community_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (user or anonymous, collection) requests."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.when(F.col("event_type") != "error", F.concat(F.lit("u"), F.col("user_id")))
        .alias("user_id"),
        F.concat(F.lit("src"), F.col("event_id") % 20).alias("collection"),
    )


def with_ctes(*names: str, then: str = "", body: str = "") -> str:
    parts = [CTE[n] for n in names]
    if then:
        parts.append(then)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
