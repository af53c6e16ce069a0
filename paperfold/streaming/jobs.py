"""Ingest job stream: message validation, attempts and dead letters, continuous index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from paperfold.functions.keys import basename, key_problem
from paperfold.schemas import JOB, JOB_SCHEMA_VERSION, PARSERS
from paperfold.session import use_state_store

MAX_RECEIVES = 3


def message_problem(body: Column, job: Column) -> Column:
    """Why a message can never succeed; NULL when it is a job."""
    keys = F.json_object_keys(body)
    stray = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in JOB.names]))) > 0

    def blank(name: str) -> Column:
        return F.coalesce(job[name], F.lit("")) == ""

    pdf = F.lower(basename(job["paper_object_key"]))
    return (
        F.when(keys.isNull() | job.isNull(), "bad_json")
        .when(stray, "extra_keys")
        .when(F.coalesce(job["schema_version"], F.lit(JOB_SCHEMA_VERSION)) != JOB_SCHEMA_VERSION,
              "wrong_schema_version")
        .when(blank("collection") | blank("paper_object_key") | blank("university"),
              "missing_field")
        .when(~F.coalesce(job["parser"].isin(*PARSERS), F.lit(False)), "unknown_parser")
        .when(job["enqueued_at"].isNotNull()
              & job["enqueued_at"].try_cast("timestamp").isNull(), "bad_timestamp")
        .when(~pdf.endswith(".pdf"), "not_a_pdf")
    )


def read_messages(raw: DataFrame) -> DataFrame:
    """body -> job columns and problem; works on a stream and on a batch."""
    df = raw.withColumn("_j", F.from_json("body", JOB))
    problem = message_problem(F.col("body"), F.col("_j"))
    return df.select(
        *raw.columns,
        F.coalesce("_j.job_id", F.sha2("body", 256)).alias("job_id"),
        *[F.col(f"_j.{n}").alias(n) for n in
          ("collection", "paper_object_key", "parser", "university", "enqueued_at")],
        problem.alias("problem"),
    )


def split_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, poison messages)."""
    df = read_messages(raw)
    return (
        df.filter(F.col("problem").isNull()).drop("problem"),
        df.filter(F.col("problem").isNotNull()).select(*raw.columns, "problem"),
    )


def attempts(receives: DataFrame, limit: int = MAX_RECEIVES) -> DataFrame:
    """Batch form: per job its receives and fate.

    receives: job_id, ok, seq (arrival order). The first success acknowledges the job;
    ``limit`` receives without one send it to the dead letters. What comes after either
    does not count.
    """
    nth = F.row_number().over(W.partitionBy("job_id").orderBy("seq"))
    return receives.withColumn("nth", nth).filter(F.col("nth") <= limit).groupBy("job_id").agg(
        F.max("nth").alias("n"), F.min(F.when(F.col("ok"), F.col("nth"))).alias("first_ok")
    ).select(
        "job_id", F.coalesce("first_ok", "n").cast("bigint").alias("receives"),
        F.when(F.col("first_ok").isNotNull(), "acked").when(F.col("n") >= limit, "dead_letter")
        .otherwise("retry").alias("fate"),
    )


# A queue keeps messages for at most two weeks; so long a job's state may matter.
RETENTION_MS = 14 * 86_400 * 1000


class AttemptCounter(StatefulProcessor):
    """Keyed by job_id: counts receives until a success or the limit."""

    OUTPUT = T.StructType().add("job_id", T.StringType()).add(
        "receives", T.LongType()
    ).add("fate", T.StringType())

    def __init__(self, limit: int = MAX_RECEIVES, expire: bool = False) -> None:
        self.limit = limit
        self.ttl = {"ttlDurationMs": RETENTION_MS} if expire else {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint, closed boolean", **self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        n, closed = self.seen.get() if self.seen.exists() else (0, False)
        out = []
        # All receives that a micro-batch brings for the job, whatever Arrow batches hold them.
        for ok in pd.concat([batch[["seq", "ok"]] for batch in rows]).sort_values("seq")["ok"]:
            if closed:
                break
            n += 1
            if ok or n >= self.limit:
                closed = True
                out.append((key[0], n, "acked" if ok else "dead_letter"))
        self.seen.update((n, closed))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "receives", "fate"])

    def close(self) -> None:
        pass


def attempt_fates(receives: DataFrame, limit: int = MAX_RECEIVES, expire: bool = False) -> DataFrame:
    """Streaming form: emits a job once, when it is acknowledged or given up.

    receives: job_id, ok, seq (arrival order). Needs the RocksDB state store.
    ``expire`` drops a job's state after the queue's retention; for streams that run on, not
    for those that end by themselves (availableNow).
    """
    use_state_store(receives.sparkSession)
    return receives.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=AttemptCounter(limit, expire), outputStructType=AttemptCounter.OUTPUT,
        outputMode="Append", timeMode="ProcessingTime" if expire else "None",
    )


def ingest_stream(raw: DataFrame, index_batch: Callable[..., None], dead_path: str, checkpoint: str,
                  with_id: bool = False) -> DataStreamWriter:
    """Continuous ingest: per micro-batch, poison goes to the dead letters and the
    jobs are indexed. A replayed batch converges if ``index_batch`` is a keyed upsert,
    or, with ``with_id``, writes under the batch id as the dead letters do."""

    def run(batch: DataFrame, batch_id: int) -> None:
        jobs, poison = split_messages(batch)
        poison.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        index_batch(jobs, batch_id) if with_id else index_batch(jobs)

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def plan_submissions(pdfs: DataFrame, collection: str, staged: DataFrame,
                     force: bool = False) -> DataFrame:
    """submit / skip per PDF; an unacceptable key is reported as invalid.

    pdfs: name. staged: key (object listing).
    """
    key = F.concat(F.lit(f"source-pdfs/{collection}/"), F.col("name"))
    df = pdfs.select("name", key.alias("key"))
    have = staged.select("key", F.lit(True).alias("_have")).distinct()
    df = df.join(have, "key", "left")
    problem = key_problem("key")
    return df.select("name", "key", (
        F.when(problem.isNotNull(), "invalid")
        .when(F.lit(not force) & F.col("_have"), "skip")
        .otherwise("submit")
    ).alias("action"))


def outcome_counts(actions: DataFrame, column: str = "action") -> DataFrame:
    return actions.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
