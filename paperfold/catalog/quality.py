"""Queries over table checks, render blocks, media, manifests and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.bridge import with_ctes
from paperfold.catalog.corpus import LINES, bracket_chunks
from paperfold.catalog.registry import query
from paperfold.functions import blocks as B
from paperfold.functions.keys import artifact_key, run_id
from paperfold.operators import artifacts as AR
from paperfold.operators import quality as Q
from paperfold.operators import upsert as U


@query("duplicate_texts", """
SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"))
    return Q.duplicates(docs, ["digest"])


@query("active_override_duplicates", """
SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey
HAVING count(*) > 1""")
def active_override_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial unique key: only active rows count."""
    return Q.duplicates(
        b.table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_acctbal") > 0
    )


@query("orphaned_labels", """
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def orphaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = b.table(spark, sf_dir, "embeddings").select("vec_id")
    labels = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return Q.orphans(emb, labels, ["vec_id"])


@query("missing_parents", with_ctes("ch", body="""
SELECT c.chunk_id, c.parent_chunk_id FROM ch c
WHERE c.chunk_level = 'sub_question' AND NOT EXISTS (SELECT 1 FROM ch p WHERE p.chunk_id = c.parent_chunk_id
  AND NOT (p.chunk_level = 'question' AND p.doc_id % 7 = 3))"""))
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-questions whose parent is gone: some questions are taken out of the whole table."""
    gone = (F.col("chunk_level") == "question") & (F.col("doc_id") % 7 == 3)
    rows = b.chunks(spark, sf_dir).filter(~gone)
    return Q.missing_parents(rows).select("chunk_id", "parent_chunk_id")


@query("row_check_failures", """
SELECT c_custkey, 'role' AS "check" FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'status' FROM customer WHERE c_nationkey % 2 = 1
UNION ALL SELECT c_custkey, 'email_normalised' FROM customer WHERE c_custkey % 2 = 0""")
def row_check_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "member").when(
            F.col("c_mktsegment") == "MACHINERY", "admin"
        ).otherwise(F.col("c_mktsegment")).alias("role"),
        F.when(F.col("c_nationkey") % 2 == 0, "active").otherwise("gone").alias("status"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lower("c_name"))
        .alias("email"),
    )
    return Q.check_failures(rows, Q.membership_checks() | Q.user_checks(), ["c_custkey"])


@query("index_permutations", """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey
HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)""")
def index_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are not 1..n exactly once."""
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("index")
    )
    return Q.index_permutation(rows, ["l_orderkey"])


def odd_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with one render block per line, of varying and partly broken kinds."""
    def one(line: Column, i: Column) -> Column:
        k = (i + F.col("doc_id")) % 9
        lines = F.array(F.array(line))
        return (
            F.when(k == 0, B.block("paragraph", runs=F.array(B.text_run(line))))
            .when(k == 1, B.block("paragraph"))
            .when(k == 2, B.block("list", marker=F.lit("star"),
                                  items=F.array(F.array(B.text_run(line)))))
            .when(k == 3, B.block("equation", latex=line))
            .when(k == 4, B.block("table", rows=lines))
            .when(k == 5, B.block("table", rows=F.slice(lines, 1, 0)))
            .when(k == 6, B.block("image", media_id=F.lit("")))
            .when(k == 7, B.block("code", code=line, latex=line))
            .otherwise(B.block("video"))
        )

    blocks = F.transform(F.split("text", "\n"), one)
    return b.texts(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "text",
        F.when(F.col("doc_id") % 10 == 0, F.lit(None))
        .when(F.col("doc_id") % 10 == 1, B.no_blocks()).otherwise(blocks).alias("render_blocks"),
    )


@query("render_block_problems", f"WITH {LINES}" + """
SELECT 'd' || doc_id AS chunk_id, i AS block_index, CASE (i + doc_id) % 9 WHEN 1 THEN 'missing_runs'
  WHEN 2 THEN 'bad_marker' WHEN 5 THEN 'table_without_rows' WHEN 6 THEN 'image_without_media_id'
  WHEN 7 THEN 'extra_latex' WHEN 8 THEN 'unknown_type' END AS problem
FROM lines WHERE doc_id % 10 > 1 AND (i + doc_id) % 9 IN (1, 2, 5, 6, 7, 8)""")
def render_block_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.render_block_problems(odd_blocks(spark, sf_dir))


@query("render_block_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 = 0) AS null_blocks,
  count(*) FILTER (WHERE doc_id % 10 <= 1 AND length(trim(text)) > 0) AS empty_with_text FROM documents""")
def render_block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.render_block_summary(odd_blocks(spark, sf_dir))


@query("render_block_sample", """
SELECT 'd' || doc_id AS chunk_id FROM documents WHERE doc_id % 10 <= 1 AND length(trim(text)) > 0
ORDER BY chunk_id LIMIT 5""")
def render_block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = Q.empty_with_text(odd_blocks(spark, sf_dir)).select("chunk_id")
    return Q.bounded_sample(bad, "chunk_id")


@query("excerpt_blocks", f"WITH RECURSIVE {LINES}" + """,
blk AS (SELECT doc_id, i, length(line) AS len, i % 3 = 1 AS par FROM lines),
fold AS (
  SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chars, FALSE AS has, FALSE AS stop FROM blk
  UNION ALL
  SELECT f.doc_id, b.i, f.n + CASE WHEN f.stop THEN 0 WHEN s <= 500 THEN 1 WHEN b.par AND NOT f.has THEN 1 ELSE 0 END,
    CASE WHEN NOT f.stop AND s <= 500 THEN s ELSE f.chars END,
    f.has OR (NOT f.stop AND b.par), f.stop OR s > 500
  FROM (SELECT f.*, b.i AS bi, CASE WHEN b.len = 0 THEN f.chars WHEN f.chars = 0 THEN b.len
          ELSE f.chars + 2 + b.len END AS s FROM fold f JOIN blk b ON b.doc_id = f.doc_id AND b.i = f.i + 1) f
  JOIN blk b ON b.doc_id = f.doc_id AND b.i = f.bi),
last AS (SELECT doc_id, arg_max(n, i) AS n, arg_max(has, i) AS has, max(i) >= 1 AS any_par FROM fold GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 AND (has OR NOT any_par) THEN n WHEN n > 0 AND any_par THEN n + 1
  ELSE 1 END AS blocks FROM last""")
def excerpt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks (every third a paragraph), cut to a 500-character excerpt."""
    def one(line: Column, i: Column) -> Column:
        return F.when(i % 3 == 1, B.block("paragraph", runs=F.array(B.text_run(line)))).otherwise(
            B.block("code", code=line)
        )

    docs = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", "\n").alias("ls")
    ).select("doc_id", F.transform(F.transform("ls", _strip), one).alias("blocks"))
    return docs.select("doc_id", F.size(B.excerpt_blocks("blocks", 500)).alias("blocks"))


def _strip(c: Column) -> Column:
    from paperfold.functions.text import strip

    return strip(c)


def raw_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored media references of varying validity (JSON text)."""
    k = F.col("event_id") % 12
    ref = F.to_json(F.struct(
        F.when(k != 1, F.concat(F.lit("image_"), F.col("event_id"))).otherwise("").alias("media_id"),
        F.when(k == 2, "video").otherwise("image").alias("kind"),
        F.when(k == 3, "nearby").otherwise("direct").alias("relation"),
        F.when(k == 4, "/abs/x.png").when(k == 5, F.lit(None)).otherwise("a/b.png").alias("object_key"),
        F.when(k == 6, 0).otherwise(3).alias("page_number"),
        F.when(k == 7, F.array(F.lit(1.0), F.lit(2.0))).otherwise(
            F.array(F.lit(0.0), F.lit(1.5), F.lit(2.0), F.lit(3.0))).alias("bbox"),
        F.when(k == 8, F.lit(-1)).otherwise(0).alias("order_index"),
        F.when(k == 9, "/tmp/x").alias("file_path"),
        F.when(k == 10, "z").alias("colour"),
        F.when(k == 11, "").otherwise("question").alias("owner_level"),
    ))
    return b.table(spark, sf_dir, "events").select("event_id", "user_id", ref.alias("ref"))


@query("media_ref_problems", """
SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'bad_media_id' WHEN 2 THEN 'bad_kind'
  WHEN 3 THEN 'bad_relation' WHEN 4 THEN 'bad_object_key' WHEN 6 THEN 'bad_page_number'
  WHEN 7 THEN 'bad_bbox' WHEN 8 THEN 'bad_order_index' WHEN 9 THEN 'forbidden_field'
  WHEN 10 THEN 'unknown_field' WHEN 11 THEN 'bad_owner_level' END AS problem,
  event_id % 12 NOT IN (1, 2, 3, 4, 9) AS readable FROM events""")
def media_ref_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_media(spark, sf_dir).select(
        "event_id", Q.media_ref_problem("ref").alias("problem"),
        Q.readable_media_ref("ref").alias("readable"),
    )


@query("media_map_load", """
SELECT event_id // 3 AS map_path, count(*) AS n FROM events GROUP BY event_id // 3
HAVING bool_and(event_id % 12 NOT IN (1, 2, 3, 4, 9))""")
def media_map_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map file per three references: a bad one voids its whole file."""
    entries = raw_media(spark, sf_dir).select(
        F.floor(F.col("event_id") / 3).alias("map_path"), "event_id", "ref"
    )
    kept = AR.load_media_map(entries, Q.readable_media_ref("ref"))
    return kept.groupBy("map_path").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_media_chunks", """
SELECT DISTINCT 'd' || l_partkey AS chunk_id FROM lineitem
WHERE l_partkey NOT IN (SELECT doc_id FROM documents)""")
def unknown_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_partkey")).alias("chunk_id")
    )
    return Q.unknown_media_chunks(media, b.chunks(spark, sf_dir))


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as conversion output: a PDF, its content list, sometimes markdown and
    an image."""
    d = F.col("doc_id")
    stem = F.concat(F.lit("Paper "), d)
    parts = F.array(
        F.struct(F.lit("source_pdf").alias("kind"), F.concat(stem, F.lit(".pdf")).alias("path"),
                 F.lit("pdf:").alias("tag")),
        F.struct(F.lit("content_list").alias("kind"),
                 F.concat(stem, F.lit("_content_list.json")).alias("path"), F.lit("cl:").alias("tag")),
        F.when(d % 2 == 0, F.struct(F.lit("markdown").alias("kind"),
               F.concat(stem, F.lit(".md")).alias("path"), F.lit("md:").alias("tag"))),
        F.when(d % 3 == 0, F.struct(F.lit("image").alias("kind"),
               F.concat(F.lit("images/i"), d, F.lit(".png")).alias("path"), F.lit("im:").alias("tag"))),
    )
    rows = b.table(spark, sf_dir, "documents").select(
        "doc_id", "text", stem.alias("paper_id"),
        F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("f"),
    )
    return rows.select(
        "doc_id", "paper_id", "f.kind", "f.path",
        F.encode(F.concat("f.tag", "text"), "UTF-8").alias("content"),
    )


ART_SQL = """files AS (
  SELECT doc_id, 'source_pdf' AS kind, 'pdf:' || text AS body, '' AS name FROM documents
  UNION ALL SELECT doc_id, 'content_list', 'cl:' || text, 'content_list.json' FROM documents
  UNION ALL SELECT doc_id, 'markdown', 'md:' || text, 'document.md' FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'image', 'im:' || text, 'images/i' || doc_id || '.png' FROM documents WHERE doc_id % 3 = 0),
cat AS (SELECT doc_id, 'Paper ' || doc_id AS paper_id, kind, sha256(body) AS sha256_hex,
   strlen(body) AS size_bytes,
   CASE WHEN kind = 'source_pdf' THEN 'blobs/sha256/' || sha256(body)[1:2] || '/' || sha256(body)[3:4] || '/' || sha256(body) || '.pdf'
        ELSE 'artifacts/mineru/run-paper-' || doc_id || '/' || name END AS key FROM files)"""


@query("artifact_catalogue", "WITH " + ART_SQL + """
SELECT paper_id, kind, key, sha256_hex, size_bytes, CASE kind WHEN 'source_pdf' THEN 'application/pdf'
  WHEN 'content_list' THEN 'application/json' WHEN 'markdown' THEN 'text/markdown' ELSE 'image/png' END
  AS content_type FROM cat""")
def artifact_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.artifact_catalogue(artifact_files(spark, sf_dir)).select(
        "paper_id", "kind", "key", "sha256_hex", "size_bytes", "content_type"
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = AR.artifact_catalogue(artifact_files(spark, sf_dir))
    return AR.build_manifests(cat, "v1", F.lit("2024-05-01 10:00:00").cast("timestamp"))


@query("manifest_roundtrip", "WITH " + ART_SQL + """
SELECT paper_id, CASE WHEN doc_id % 4 = 1 THEN 'invalid_source_pdf_key' WHEN doc_id % 4 = 2
    THEN 'timestamp_without_zone' WHEN doc_id % 4 = 3 THEN 'missing_field' END AS reason,
  CASE WHEN doc_id % 4 = 0 THEN count(*) FILTER (WHERE kind <> 'source_pdf') END AS n_artifacts
FROM cat GROUP BY paper_id, doc_id""")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written as JSON, some of them damaged, and read back."""
    k = F.regexp_extract("paper_id", r"(\d+)", 1).cast("int") % 4
    rows = manifests(spark, sf_dir).withColumn("path", F.col("paper_id"))
    texts = AR.manifest_json(rows)
    k = F.regexp_extract("path", r"(\d+)", 1).cast("int") % 4
    broken = texts.withColumn("value", (
        F.when(k == 1, F.replace("value", F.lit("blobs/"), F.lit("/blobs/")))
        .when(k == 2, F.replace("value", F.lit("+00:00"), F.lit("")))
        .when(k == 3, F.replace("value", F.lit('"mineru_version"'), F.lit('"other_version"')))
        .otherwise(F.col("value"))
    ))
    good, bad = AR.parse_manifests(broken)
    return good.select(
        F.col("path").alias("paper_id"), F.lit(None).cast("string").alias("reason"),
        F.size("artifacts").alias("n_artifacts"),
    ).unionByName(bad.select(
        F.col("path").alias("paper_id"), "reason", F.lit(None).cast("int").alias("n_artifacts")
    ))


@query("manifest_ownership", """
SELECT 'Paper ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || '.pdf' AS source_pdf,
  'paper_id_mismatch' AS problem, 1 AS n FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'Paper ' || doc_id || 'x.pdf', 'key_mismatch', 1 + CAST(doc_id % 2 = 0 AS INT)
FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'Paper ' || doc_id || 'x.pdf', 'image_outside_namespace', 1
FROM documents WHERE doc_id % 15 = 0""")
def manifest_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("paper_id", r"(\d+)", 1).cast("int")
    rows = manifests(spark, sf_dir).withColumn(
        "source_pdf", F.concat("paper_id", F.when(k % 5 == 0, "x").otherwise(""), F.lit(".pdf"))
    )
    return AR.ownership_problems(rows).groupBy("source_pdf", "problem").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("artifact_reuse", """
SELECT 'Paper ' || doc_id AS paper_id,
  CASE WHEN doc_id % 7 = 1 THEN 'upload' WHEN doc_id % 7 = 2 THEN 'upload' WHEN doc_id % 7 = 3 THEN 'convert'
       WHEN doc_id % 7 = 4 THEN 'upload' ELSE 'reuse' END AS status,
  CASE WHEN doc_id % 7 = 1 THEN 'no_manifest' WHEN doc_id % 7 = 2 THEN 'artifact_set_differs'
       WHEN doc_id % 7 = 3 THEN 'pdf_changed' WHEN doc_id % 7 = 4 THEN 'object_missing' END AS reason
FROM documents""")
def artifact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk against manifests against the object listing, with planted differences."""
    num = F.regexp_extract("paper_id", r"(\d+)", 1).cast("int") % 7
    cat = AR.artifact_catalogue(artifact_files(spark, sf_dir))
    on_disk = cat.filter("kind <> 'source_pdf'").select("paper_id", "key").unionByName(
        cat.filter("kind = 'source_pdf'").filter(num == 2).select(
            "paper_id", artifact_key(run_id("paper_id"), F.lit("image"), F.lit("new.png")).alias("key")
        )
    )
    known = manifests(spark, sf_dir).filter(num != 1).withColumn(
        "declared_paper_id", F.col("paper_id")
    )
    pdfs = cat.filter("kind = 'source_pdf'").select(
        "paper_id", F.when(num == 3, F.sha2("sha256_hex", 256)).otherwise(F.col("sha256_hex"))
        .alias("sha256_hex"),
    )
    stored = cat.filter(~((num == 4) & (F.col("kind") == "content_list"))).select("key").unionByName(
        known.select(artifact_key("conversion_run_id", F.lit("manifest"), F.lit("")).alias("key"))
    )
    return AR.classify_reuse(on_disk, known, pdfs, stored)


@query("artifact_integrity", "WITH " + ART_SQL + """
SELECT key, CASE WHEN doc_id % 3 = 1 THEN 'hash_mismatch' ELSE 'size_mismatch' END AS problem
FROM cat WHERE kind = 'content_list' AND doc_id % 3 > 0""")
def artifact_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.regexp_extract("paper_id", r"(\d+)", 1).cast("int") % 3
    files = artifact_files(spark, sf_dir).filter("kind = 'content_list'").withColumn(
        "key", artifact_key(run_id("paper_id"), F.lit("content_list"), F.lit(""))
    )
    declared = AR.artifact_catalogue(files).select(
        "key",
        F.when(num == 1, F.sha2("sha256_hex", 256)).otherwise(F.col("sha256_hex")).alias("sha256_hex"),
        (F.col("size_bytes") + F.when(num == 2, 1).otherwise(0)).alias("size_bytes"),
    )
    return AR.integrity_problems(files, declared)


@query("media_object_keys", """
SELECT doc_id, problem, count(*) AS n FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'missing_manifest' WHEN i % 2 = 1 THEN 'missing_mapping' ELSE 'ok' END AS problem
  FROM (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
        FROM documents WHERE doc_id % 2 = 0)
  WHERE i % 3 = 2) GROUP BY doc_id, problem""")
def media_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk media of the bracket papers joined to image artifacts by base name."""
    num = F.regexp_extract("source_pdf", r"(\d+)", 1).cast("bigint")
    media = bracket_chunks(spark, sf_dir).filter("chunk_level = 'question'").select(
        F.col("id").alias("chunk_id"), "source_pdf", F.explode("media").alias("m")
    ).select("chunk_id", "source_pdf", "m.*")
    artifacts = b.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 5 != 1).select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf")).alias("source_pdf"),
        F.lit("image").alias("kind"),
        F.explode(F.transform(
            F.sequence(F.lit(0), F.size(F.split("text", "\n")), F.lit(2)),
            lambda i: F.concat(F.lit("artifacts/"), F.col("doc_id"), F.lit("/"), i, F.lit(".png")),
        )).alias("key"),
    )
    good, bad = AR.map_media(media, artifacts)
    both = good.select("source_pdf", F.lit("ok").alias("problem")).unionByName(
        bad.select("source_pdf", "problem")
    )
    return both.groupBy(num.alias("doc_id"), "problem").agg(F.count(F.lit(1)).alias("n"))


@query("keyed_upsert", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents
WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE doc_id % 4 = 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replaced by incoming ones with the same key; the rest untouched."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id")
    stored = docs.filter("doc_id % 4 <> 1").withColumn("origin", F.lit("old"))
    incoming = docs.filter("doc_id % 4 <= 1").select(
        F.when(F.col("doc_id") % 4 == 1, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
        .alias("doc_id"), F.lit("new").alias("origin"),
    ).filter("doc_id % 4 = 0 OR doc_id >= 1000000")
    return U.upsert_rows(stored, incoming, ["doc_id"])


@query("collection_drift", """
SELECT name, unnest(list_filter([CASE WHEN n % 2 = 1 AND n % 4 <> 0 THEN 'community_moved' END,
    CASE WHEN n % 3 = 1 THEN 'model_mismatch' END, CASE WHEN n % 5 = 1 THEN 'dimension_mismatch' END,
    CASE WHEN n % 7 = 1 THEN 'schema_changed' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)""")
def collection_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("name", 4, 9).cast("int")
    stored = b.collections(spark, sf_dir).select(
        "name", "community_id", F.lit("m1").alias("embedding_model_id"),
        F.lit(64).alias("embedding_dimension"), F.lit("{}").alias("metadata_schema"),
    )
    incoming = stored.select(
        "name",
        F.when(n % 2 == 1, F.concat(F.coalesce("community_id", F.lit("")), F.lit("x")))
        .alias("community_id"),
        F.when(n % 3 == 1, "m2").otherwise("m1").alias("embedding_model_id"),
        F.when(n % 5 == 1, 128).otherwise(64).alias("embedding_dimension"),
        F.when(n % 7 == 1, '{"version":2}').otherwise("{}").alias("metadata_schema"),
    )
    return U.collection_drift(stored, incoming)


@query("collection_recreate", """
SELECT 'collections' AS part, count(DISTINCT source) AS n FROM documents WHERE source <> 'src1'
UNION ALL SELECT 'chunks', count(*) FROM documents WHERE source <> 'src1'""")
def collection_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropping one collection removes its rows from every table."""
    tables = {
        "collections": b.collections(spark, sf_dir),
        "chunks": b.table(spark, sf_dir, "documents").select(F.col("source").alias("collection")),
    }
    left = U.drop_collection(tables, "src1")
    return left["collections"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("collections").alias("part"), "n"
    ).unionByName(left["chunks"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("chunks").alias("part"), "n"
    ))


@query("paper_registry", """
SELECT source, lang || '.pdf' AS source_pdf, lang = 'en' AS was_known FROM documents GROUP BY source, lang""")
def paper_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers get-or-created from the chunks that name them."""
    docs = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("collection"), F.concat("lang", F.lit(".pdf")).alias("source_pdf")
    )
    known = docs.filter("source_pdf = 'en.pdf'").distinct().withColumn("paper_id", F.lit("k"))
    return U.get_or_create_papers(known, docs).select(
        F.col("collection").alias("source"), "source_pdf",
        (F.col("paper_id") == "k").alias("was_known"),
    )


