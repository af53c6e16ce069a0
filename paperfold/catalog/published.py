"""Queries over published index runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.corpus import bracket_papers
from paperfold.catalog.registry import query
from paperfold.catalog.streams import messages, run_to_end, table_stream
from paperfold.functions.providers import hashing_embedder
from paperfold.operators.upsert import CheckFailed
from paperfold.plans.published import Published, index_run
from paperfold.session import fresh_dir, materialise
from paperfold.streaming.ingest import ingest_and_index

SCHEMA = [f for f in b.SCHEMA if f["key"] in ("year", "topic")]


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunker output; collections are named 000 to 019."""
    none = F.array().cast("array<struct<media_id:string>>")
    return b.chunks(spark, sf_dir).select(
        F.lpad(F.substring("source", 4, 9), 3, "0").alias("collection"), F.col("chunk_id").alias("id"), "chunk_level", "parent_chunk_id",
        F.lit(None).cast("string").alias("sub_question_label"), "text", F.concat("lang", F.lit(".pdf")).alias("source_pdf"),
        "year", "topic", "doc_id", none.alias("render_blocks"), none.alias("media"))


def settings(rows: DataFrame, community: str | None, display: str, dimension: int = 16) -> DataFrame:
    return rows.select(F.col("collection").alias("name")).distinct().select(
        "name", F.lit(community).cast("string").alias("community_id"), F.lit(display).alias("display_name"), F.lit("hash-16").alias("embedding_model_id"),
        F.lit(dimension).alias("embedding_dimension"), F.lit('{"version":1}').alias("metadata_schema"))


@query("index_runs", """
WITH d AS (SELECT doc_id, lang, lpad(substr(source, 4), 3, '0') AS collection FROM documents),
k AS (SELECT *, CAST(collection AS INTEGER) % 5 = 0 AS again FROM d),
r AS (SELECT *, NOT again AND doc_id % 3 = 0 AS second FROM k WHERE CASE WHEN again THEN doc_id % 7 < 3 ELSE doc_id % 2 = 0 OR doc_id % 3 = 0 END)
SELECT collection, CASE WHEN bool_or(again) THEN 'third' ELSE 'second' END AS display_name, CASE WHEN NOT bool_or(again) THEN 'c1' END AS community_id,
  count(*) AS chunks, count(*) FILTER (WHERE second) AS changed, count(*) AS vectors, count(DISTINCT lang) AS papers, 3 AS runs, TRUE AS refused
FROM r GROUP BY collection""")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three published runs: a first batch, a batch that replaces and adds, a fifth of the
    collections recreated from other rows. A run whose dimension drifts is refused between
    them and changes nothing."""
    store = Published(spark, fresh_dir(spark, "runs"), buckets=2)
    rows, embed, n = chunk_rows(spark, sf_dir), hashing_embedder(16), F.col("collection").cast("int")
    first = rows.where("doc_id % 2 = 0")
    index_run(store, first, settings(rows, None, "first"), SCHEMA, embed)
    second = rows.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("v2 "), "text"))
    index_run(store, second, settings(rows, "c1", "second"), SCHEMA, embed)
    refused = False
    try:
        index_run(store, first, settings(rows, "c1", "no", 32), SCHEMA, hashing_embedder(32))
    except CheckFailed:
        refused = True
    again = rows.where(n % 5 == 0)
    names = [r[0] for r in again.select("collection").distinct().collect()]  # named by the caller
    index_run(store, again.where("doc_id % 7 < 3"), settings(again, None, "third"), SCHEMA, embed, recreate=tuple(names))
    count = lambda name: store.table(name).groupBy("collection").agg(F.count(F.lit(1)).alias(name))
    changed = F.count_if(F.startswith("text", F.lit("v2 "))).alias("changed")
    return (store.table("collections").select("collection", "display_name", "community_id")
            .join(store.table("chunks").groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"), changed), "collection")
            .join(count("vectors"), "collection").join(count("papers"), "collection")
            .withColumn("runs", F.lit(len(store.runs()))).withColumn("refused", F.lit(refused)))


@query("ingest_indexes", """
WITH m AS (SELECT DISTINCT 'src' || (event_id % 20) AS collection, user_id FROM events WHERE event_id % 9 IN (0, 8)),
d AS (SELECT doc_id, doc_id % 25 + 2000 AS year, doc_id % 9 + 1 AS paper, 1 + least((len(string_split(text, chr(10))) + 2) // 3, 26) AS chunks FROM documents)
SELECT collection, count(*) AS papers, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(chunks) AS BIGINT) AS vectors FROM m JOIN d ON d.doc_id = m.user_id GROUP BY collection""")
def ingest_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ingest jobs: every valid one indexes the paper of its document."""
    store = Published(spark, fresh_dir(spark, "runs"), buckets=1)
    number = F.regexp_extract("path", "d([0-9]+)_content_list", 1)
    lists = materialise(bracket_papers(spark, sf_dir).select(F.concat(F.lit("source-pdfs/d"), number, F.lit(".PDF")).alias("paper_object_key"), "value"), "lists")
    run_to_end(ingest_and_index(messages(table_stream(spark, sf_dir, "events")), lists, lambda c: settings(c, None, "ingested"), SCHEMA,
                                hashing_embedder(16), store, fresh_dir(spark, "dead"), fresh_dir(spark, "ckpt")))
    count = lambda name: store.table(name).groupBy("collection").agg(F.count(F.lit(1)).alias(name))
    return count("papers").join(count("chunks"), "collection").join(count("vectors"), "collection")
