"""The declared constraints over driver tables with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperfold.catalog import bridge as b
from paperfold.catalog.registry import query
from paperfold.operators import constraints as C

# Each stored table as a query over driver tables, in SQL that both engines read alike.
STORED = {
    "users": """SELECT 'u' || c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'U' || c_custkey || '@X.org' WHEN c_custkey % 41 = 1 THEN 'dup@x.org'
  ELSE 'u' || c_custkey || '@x.org' END AS email, CASE WHEN c_custkey % 97 <> 0 THEN c_custkey % 2 = 0 END AS email_verified FROM customer""",
    "user_external_identities": """SELECT 'i' || c_custkey AS id, 'u' || CASE WHEN c_custkey % 30 = 0 THEN c_custkey + 100000000 ELSE c_custkey END AS user_id, 'oidc' AS provider,
  CASE WHEN c_custkey % 71 <> 0 THEN 's' || CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END END AS external_subject FROM customer""",
    "communities": "SELECT 'c' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 8 = 0 THEN 'slug' ELSE lower(n_name) END AS slug FROM nation",
    "community_memberships": """SELECT 'm' || o_orderkey AS id, 'u' || o_custkey AS user_id, 'c' || (o_orderkey % 27) AS community_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'owner' ELSE 'member' END AS role, CASE WHEN o_orderstatus = 'P' THEN 'paused' ELSE 'active' END AS status FROM orders""",
    "community_email_domains": """SELECT 'd' || n_nationkey AS id, 'c' || n_nationkey AS community_id, CASE WHEN n_nationkey % 7 = 0 THEN n_name ELSE lower(n_name) END || '.edu' AS domain,
  CASE WHEN n_nationkey % 6 = 0 THEN 'regex' ELSE 'exact' END AS match_mode, TRUE AS is_active FROM nation""",
    "manual_access_overrides": """SELECT 'o' || c_custkey AS id, 'm' || CASE WHEN c_custkey % 4 = 0 THEN c_custkey - 2 ELSE c_custkey END || CASE WHEN c_custkey % 33 = 0 THEN '@X.org' ELSE '@x.org' END AS email,
  'c' || (c_custkey % 26) AS community_id, c_custkey % 3 <> 0 AS is_active FROM customer""",
    "collections": """SELECT DISTINCT source AS id, source AS name, 'c' || substr(source, 4) AS community_id, CASE WHEN source <> 'src4' THEN 'm' END AS embedding_model_id,
  CASE WHEN source IN ('src3', 'src5') THEN 0 ELSE 64 END AS embedding_dimension, '{}' AS metadata_schema FROM documents""",
    "papers": """SELECT DISTINCT source || '-' || lang AS id, CASE WHEN lang = 'de' THEN 'x' ELSE '' END || source AS collection_id,
  CASE WHEN lang = 'fr' THEN 'en' ELSE lang END || '.pdf' AS source_pdf FROM documents""",
    "chunks": """SELECT 'd' || doc_id AS id, 'k' || CASE WHEN doc_id % 9 = 0 THEN doc_id + 1 ELSE doc_id END AS chunk_id, 'src1' AS collection_id, source || '-' || CASE WHEN doc_id % 40 = 3 THEN 'zz' ELSE lang END AS paper_id,
  'question' AS chunk_level, CASE WHEN doc_id % 60 <> 7 THEN text END AS text, lang || '.pdf' AS source_pdf FROM documents""",
    "chunk_embeddings": "SELECT 'd' || (vec_id * 3) AS chunk_id, CASE WHEN label <> 3 THEN 'm' END AS embedding_model_id, embedding FROM embeddings",
    "request_usage_logs": """SELECT 'l' || event_id AS id, 'r' || CASE WHEN event_id % 12 = 5 THEN event_id - 1 ELSE event_id END AS request_id, event_type AS endpoint, 'src1' AS collection_name,
  CASE WHEN event_id % 4 <> 0 THEN 'u' || (user_id * 7) END AS app_user_id, 'ok' AS outcome, CASE WHEN event_id % 45 <> 0 THEN 1 END AS latency_ms FROM events""",
}


def stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    sources = {t: b.table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "documents", "embeddings", "events")}
    reads = {name: next(t for t in sources if sql.endswith(f"FROM {t}")) for name, sql in STORED.items()}
    return {name: spark.sql(sql.replace(f"FROM {reads[name]}", "FROM {source}").replace("'{}'", "'{{}}'"), source=sources[reads[name]]) for name, sql in STORED.items()}


@query("declared_constraints", "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in STORED.items()) + "\n" + C.as_sql())
def declared_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared constraint and how many rows break it."""
    return C.violations(stored_tables(spark, sf_dir))
