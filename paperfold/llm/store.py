"""Stages written to the cluster's shared folder, and row keys that survive a retry."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


class Stages:
    """Written stages of one operator call.

    ``put`` writes a stage and reads it back, so a lost executor costs a re-read, not a
    recomputation. ``drop`` deletes stages that nothing reads any more; what the result
    still reads stays until the cluster clears its folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, stage: str, df: DataFrame) -> DataFrame:
        path = fresh(self.spark, f"{self.name}-{stage}")
        df.write.parquet(path)
        self.paths[stage] = path
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *stages: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for stage in stages:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(stage))
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs: it acts when the
    driver collects the objects that name them."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def row_key(ident: str = "doc_id", text: str = "text") -> list[Column]:
    """(key_id, key_text): what decides about a row is the same for rows with equal id and
    text, so repeated rows may share a key; rows that only share an id don't."""
    return [F.coalesce(F.col(ident).cast("long"), F.lit(-(2**63))).alias("key_id"),
            F.xxhash64(text_of(F.col(text)), F.isnull(ident)).alias("key_text")]
