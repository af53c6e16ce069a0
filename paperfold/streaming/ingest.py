"""Continuous ingest that indexes: jobs of a micro-batch become one published run.

The keys of a batch's jobs are looked up as content lists, chunked, embedded and upserted by
``published.index_run``, which records the batch in the run's ledger. A replayed batch finds
itself there and changes nothing; a batch that failed left nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from paperfold.functions.keys import basename
from paperfold.plans.chunking import chunk_papers
from paperfold.plans.published import Published, index_run
from paperfold.schemas import CONTENT_BLOCK, PARSERS
from paperfold.session import discard, fresh_dir
from paperfold.streaming.jobs import split_messages


def one_of_each(jobs: DataFrame) -> DataFrame:
    """One job per stored paper: of several in a batch the latest counts, then the larger key."""
    order = F.struct("enqueued_at", "paper_object_key", "parser", "university")
    paper = basename("paper_object_key").alias("source_pdf")
    return jobs.groupBy("collection", paper).agg(F.max(order).alias("j")).select("collection", "source_pdf", "j.*")


def job_chunks(jobs: DataFrame, content_lists: DataFrame, staged: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with their collection, jobs that cannot be chunked with the problem).

    content_lists: paper_object_key, value (the JSON text of its blocks). A paper is chunked once
    for all jobs that name it, below ``staged``; which of its chunks each collection takes is
    decided on ids, and only then are the chunks joined, once. Of chunks of one collection that
    share an id one of the largest paper name stays.
    """
    spark = jobs.sparkSession
    key, job = F.col("paper_object_key").alias("source_pdf"), ["collection", "paper_object_key"]
    lists = content_lists.select("paper_object_key", F.col("value").isNotNull().alias("there"), F.from_json("value", T.ArrayType(CONTENT_BLOCK)).alias("blocks"))
    status = lists.select("paper_object_key", "there", F.col("blocks").isNotNull().alias("parsed"))
    problem = F.when(F.col("there").isNull() | ~F.col("there"), "content_list_missing").when(~F.col("parsed"), "not_a_block_list")
    failed = jobs.select(*job).join(status, "paper_object_key", "left").select(*job, problem.alias("problem")).where("problem IS NOT NULL")
    for parser in PARSERS:
        wanted = jobs.where(F.col("parser") == parser).select("paper_object_key").distinct()
        papers = lists.where("blocks IS NOT NULL").join(wanted, "paper_object_key", "left_semi")
        keyed = papers.select(key, F.regexp_replace("paper_object_key", r"/[^/]*\z", "").alias("base_dir"), "blocks").dropDuplicates(["source_pdf"])
        chunks = chunk_papers(keyed, parser, F.lit("\u0001"))  # ids get each job's university below
        (chunks.withColumn("parser", F.lit(parser)).withColumn("_row", F.concat_ws(" ", F.lit(parser), F.monotonically_increasing_id()))
         .write.mode("append").option("compression", "zstd").parquet(staged))
    chunks = spark.read.parquet(staged)

    def named(c: str) -> Column:
        return F.when(F.startswith(c, F.lit("\u0001-")), F.concat("university", F.substring(c, 2, 1 << 30))).otherwise(F.col(c)).alias(c)

    named_by = jobs.select(key, "parser", "collection", "university")
    pairs = chunks.select("source_pdf", "parser", "id", "_row").join(named_by, ["source_pdf", "parser"])
    last = F.max(F.struct(basename("source_pdf").alias("paper"), "_row", "university")).alias("j")
    taken = pairs.select("collection", named("id"), "source_pdf", "_row", "university").where("collection IS NOT NULL AND id IS NOT NULL").groupBy("collection", "id").agg(last).select("collection", "j._row", "j.university")
    wide = chunks.join(taken, "_row")
    return wide.select("collection", basename("source_pdf").alias("source_pdf"), named("id"), named("parent_chunk_id"),
                       *[c for c in chunks.columns if c not in ("id", "parent_chunk_id", "source_pdf", "parser", "_row")]), failed


def ingest_and_index(raw: DataFrame, content_lists: DataFrame, settings: Callable[[DataFrame], DataFrame], schema: list[dict], embedder,
                     store: Published, dead_path: str, checkpoint: str, stream: str = "ingest") -> DataStreamWriter:
    """Index the papers that job messages name. ``settings`` gives the settings of the
    collections (a frame with ``collection``) that a batch names."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if (stream, batch_id) in store.batches():
            return
        spark = batch.sparkSession
        jobs, poison = split_messages(batch)
        staged = fresh_dir(spark, "ingest-batch")
        one_of_each(jobs).write.parquet(f"{staged}/jobs")
        jobs = spark.read.parquet(f"{staged}/jobs")
        chunks, failed = job_chunks(jobs, content_lists, f"{staged}/chunks")
        (poison.select("body", "problem").unionByName(failed.select(F.to_json(F.struct("collection", "paper_object_key")).alias("body"), "problem"))
         .write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}"))
        index_run(store, chunks, settings(jobs.select("collection").distinct()), schema, embedder, batch=(stream, batch_id))
        discard(spark, staged)

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
