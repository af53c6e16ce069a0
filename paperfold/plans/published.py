"""Index runs: collections, papers, chunks and vectors written and published together.

A run is the state of all four tables. It is a folder ``run-<n>`` that lists, per table, the
data folders of its (collection, bucket) parts; readers open the highest run only. An index
job writes the parts that its keys touch below ``data/``, lists them together with the
untouched parts of the run before, and becomes visible by one rename after every check. A
refused or broken job removes what it wrote and leaves the published run as it was. One
writer at a time is assumed; ``expire`` deletes what only old runs use.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.metadata import typed_value
from paperfold.operators.quality import duplicates
from paperfold.operators.upsert import BUCKETS, CheckFailed, bucket_of, collection_drift, require_none
from paperfold.plans.indexing import attach_object_keys, index_rows
from paperfold.plans.search import small
from paperfold.session import fresh_dir

KEYS = {"collections": ["collection"], "papers": ["collection", "source_pdf"],
        "chunks": ["collection", "chunk_id"], "vectors": ["collection", "chunk_id"]}
SETTINGS = ["community_id", "display_name", "embedding_model_id", "embedding_dimension", "metadata_schema"]
PART = ["collection", "bucket"]


class Published:
    """The runs below one folder, which may be in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._files()
        at = path(folder)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, folder: str) -> None:
        fs, path = self._files()
        fs.delete(path(folder), True)

    def runs(self) -> list[int]:
        return sorted(int(n[4:]) for n in self._names(self.root) if n.startswith("run-"))

    def _run(self, n: int) -> str:
        return f"{self.root}/run-{n:010d}"

    def parts(self, n: int) -> DataFrame:
        """(table, collection, bucket, folder) of a run."""
        return self.spark.read.parquet(f"{self._run(n)}/parts")

    def schemas(self, n: int) -> dict[str, T.StructType]:
        rows = self.spark.read.parquet(f"{self._run(n)}/schemas").collect()
        return {r["table"]: T.StructType.fromJson(json.loads(r["schema"])) for r in rows}

    def batches(self) -> set[tuple[str, int]]:
        """The ledger of the published run: the last finished batch of each stream, the only
        one that a restart can replay."""
        known = self.runs()
        return {tuple(r) for r in self.spark.read.parquet(f"{self._run(known[-1])}/batches").collect()} if known else set()

    def read(self, schema: T.StructType, parts: DataFrame) -> DataFrame:
        """The rows of some parts: collections are pruned by the list, whatever their names."""
        folders = [f"{self.root}/{r['folder']}" for r in parts.select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def table(self, name: str, collections: list[str] | None = None, run: int | None = None) -> DataFrame | None:
        """A table of the published run; None before the first."""
        known = self.runs()
        if not known:
            return None
        run = known[-1] if run is None else run
        parts = self.parts(run).where(F.col("table") == name)
        if collections is not None:
            parts = parts.where(F.col("collection").isin(collections))
        return self.read(self.schemas(run)[name], parts)

    def expire(self, keep: int = 2) -> None:
        """Delete all but the last runs, and the data that no run lists any more."""
        old = self.runs()[:-keep]
        used = {r[0] for n in self.runs()[-keep:]
                for r in self.parts(n).select(F.split("folder", "/")[1]).distinct().collect()}
        for n in old:
            self._delete(self._run(n))
        for name in set(self._names(f"{self.root}/data")) - used:
            self._delete(f"{self.root}/data/{name}")


def write_parts(store: Published, job: str, table: str, rows: DataFrame) -> DataFrame:
    """Write rows by (collection, bucket) and return where each part lies. Folders are named
    by a hash, so a collection's name needs no escaping and is never read from a path."""
    at = f"data/{job}/{table}"
    (rows.withColumn("_c", F.md5("collection")).withColumn("_b", F.col("bucket"))
     .hint("rebalance", "_c", "_b").write.option("compression", "zstd").partitionBy("_c", "_b").parquet(f"{store.root}/{at}"))
    own = T.StructType([rows.schema[c] for c in PART])
    if not store._names(f"{store.root}/{at}") or all(not n.startswith("_c=") for n in store._names(f"{store.root}/{at}")):
        return store.spark.createDataFrame([], "table string, collection string, bucket int, folder string")
    where = F.regexp_extract(F.col("_metadata.file_path"), "(_c=[^/]+/_b=[^/]+)/[^/]*$", 1)
    return store.spark.read.schema(own).parquet(f"{store.root}/{at}").select(
        F.lit(table).alias("table"), *PART, F.concat(F.lit(f"{at}/"), where).alias("folder")).distinct()


def check_settings(settings: DataFrame, rows: DataFrame, stored: DataFrame | None) -> None:
    """Everything that refuses a job: each check looks at whole tables before anything is
    written to the store."""
    require_none(duplicates(settings, ["name"]), "a collection's settings given twice")
    if stored is not None:
        require_none(collection_drift(stored.withColumnRenamed("collection", "name").select("name", *SETTINGS), settings), "settings of a collection changed")
    names = small(settings.select(F.col("name").alias("collection"), "embedding_dimension"))
    require_none(rows.select("collection").distinct().join(names, "collection", "left_anti"), "chunks of an unknown collection")
    require_none(duplicates(rows, ["collection", "chunk_id"]), "duplicate chunk ids")
    wrong = ~F.size("embedding").eqNullSafe(F.col("embedding_dimension"))
    require_none(rows.join(names, "collection").where(wrong).select("collection", "chunk_id"), "embedding dimension mismatch")


def union_schema(table: str, old: T.StructType | None, new: T.StructType) -> T.StructType:
    """Stored columns and new ones; collections may bring metadata fields of their own, but a
    field has one type."""
    fields = {f.name: f for f in (old or [])}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise CheckFailed(f"type of {table}.{f.name} changed", [f.dataType.simpleString()])
        fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    return T.StructType(list(fields.values()))


def incoming_tables(rows: DataFrame, settings: DataFrame, schema: list[dict], stored: DataFrame | None, buckets: int) -> dict[str, DataFrame]:
    """What a job brings for each table, by its keys."""
    known = settings.select(F.col("name").alias("collection"), *SETTINGS)
    if stored is not None:
        old = stored.select("collection", F.col("community_id").alias("_community"))
        known = known.join(old, "collection", "left").withColumn("community_id", F.coalesce("community_id", "_community")).drop("_community")
    seen = rows.select("collection", "source_pdf").where("source_pdf IS NOT NULL").distinct()
    keyed = rows.withColumn("bucket", bucket_of("chunk_id", buckets))
    typed = [typed_value("metadata", f["key"], f["type"]).alias(f["key"]) for f in schema if f["key"] not in ("chunk_level", "source_pdf")]
    return {
        "collections": known.withColumn("bucket", F.lit(0)),
        "papers": seen.withColumn("paper_id", F.sha2(F.concat_ws("\u0001", "collection", "source_pdf"), 256)).withColumn("bucket", bucket_of("source_pdf", buckets)),
        "chunks": keyed.drop("embedding", "embedding_model_id"),
        "vectors": keyed.join(small(known.select("collection", F.col("embedding_model_id").alias("_model"))), "collection").select(
            *PART, "chunk_id", "chunk_level", "source_pdf", *typed, "embedding", F.col("_model").alias("embedding_model_id")),
    }


def index_run(store: Published, chunks: DataFrame, settings: DataFrame, schema: list[dict], embedder,
              recreate: tuple[str, ...] = (), artifacts: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
    """Index chunks (with their ``collection``) and publish a run; its number.

    settings: name, community_id, display_name, embedding_model_id, embedding_dimension,
    metadata_schema of every collection that the chunks name. ``recreate`` names collections
    whose stored rows leave all four tables first. Stored papers keep their ids; an incoming
    chunk replaces the stored one with its vector. ``batch`` (stream, number) is recorded in the
    run's ledger of finished batches.
    """
    spark, job = store.spark, uuid.uuid4().hex
    if artifacts is not None:
        chunks = attach_object_keys(chunks, artifacts)
    stage = fresh_dir(spark, "index-run")
    index_rows(chunks, F.col("collection"), schema, embedder, "").drop("bucket").write.option("compression", "zstd").parquet(stage)
    rows = spark.read.parquet(stage)
    known = store.runs()
    before = known[-1] if known else None
    kept = store.parts(before).where(~F.col("collection").isin(list(recreate))) if known else None
    old = store.schemas(before) if known else {}
    stored = store.read(old["collections"], kept.where("table = 'collections'")) if known else None
    staging = f"{store.root}/.staging-{job}"
    try:
        check_settings(settings, rows, stored)
        listed, schemas = [], []
        for table, new in incoming_tables(rows, settings, schema, stored, store.buckets).items():
            shape = union_schema(table, old.get(table), new.schema)
            if known:
                own = kept.where(F.col("table") == table)
                touched = new.select(*PART).distinct()
                had = store.read(old[table], own.join(touched, PART, "left_semi"))
                if table == "papers":
                    new = had.unionByName(new.join(had.select(*KEYS[table]), KEYS[table], "left_anti"))
                else:
                    new = had.join(new.select(*KEYS[table]), KEYS[table], "left_anti").unionByName(new, allowMissingColumns=True)
                listed.append(own.join(touched, PART, "left_anti").select("table", *PART, "folder"))
            listed.append(write_parts(store, job, table, new.select(*[c for c in shape.names if c in new.columns])))
            schemas.append((table, shape.json()))
        reduce(DataFrame.unionByName, listed).coalesce(1).write.parquet(f"{staging}/parts")
        spark.createDataFrame(schemas, "table string, schema string").coalesce(1).write.parquet(f"{staging}/schemas")
        done = {**dict(sorted(store.batches())), **dict([batch] if batch else [])}  # a stream replays its last batch only
        done = sorted(done.items())
        spark.createDataFrame(done, "stream string, number long").coalesce(1).write.parquet(f"{staging}/batches")
        return publish(store, staging, (before or 0) + 1)
    except BaseException:
        store._delete(staging)
        store._delete(f"{store.root}/data/{job}")
        raise
    finally:
        store._delete(stage)


def publish(store: Published, staging: str, n: int) -> int:
    """The one step that readers see."""
    fs, path = store._files()
    target = path(store._run(n))
    if fs.exists(target) or not fs.rename(path(staging), target):
        raise CheckFailed(f"run {n} exists already", [])
    return n
