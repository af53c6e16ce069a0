"""Keyed upserts into parquet tables, and the checks around them.

A stored table is partitioned by (collection, bucket), bucket = hash of the chunk id.
An upsert rewrites only the partitions its keys fall into: unchanged rows stay by an
anti join, and the result is swapped in by a dynamic partition overwrite, whose commit
replaces the old files once all new ones are written. One writer at a time is assumed. Re-running the same batch gives
the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from paperfold.session import discard, fresh_dir

BUCKETS = 64
PARTITIONS = ("collection", "bucket")


class CheckFailed(ValueError):
    """A table-level check found violations; ``rows`` holds a bounded sample."""

    def __init__(self, name: str, rows: list) -> None:
        super().__init__(f"{name}: {rows}")
        self.rows = rows


def require_none(violations: DataFrame, name: str) -> None:
    """Fail when there is any violation, showing at most five."""
    sample = violations.limit(5).collect()
    if sample:
        raise CheckFailed(name, [r.asDict() for r in sample])


def upsert_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables where an incoming key replaces the stored row."""
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables where a stored key wins."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"),
                                allowMissingColumns=True)


def bucket_of(column: str = "chunk_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The stored table, or None. ``schema`` types the partition columns: left to themselves
    they are guessed from folder names, and collection "007" would come back as 7."""
    try:
        found = spark.read.parquet(path)
        if schema is None:
            return found
        known = {f.name: f for f in schema}
        own = [known.get(f.name, f) for f in found.schema]
        return spark.read.schema(T.StructType(own)).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def upsert_table(path: str, incoming: DataFrame, keys: list[str], staged: bool = False) -> None:
    """Upsert ``incoming`` (with its partition columns) into the table at ``path``.

    ``staged`` says that ``incoming`` reads written files, so it needs no copy of its own.
    Wide rows are joined only where a touched partition holds a row that stays.
    """
    spark = incoming.sparkSession
    stage = None if staged else fresh_dir(spark, "stage")
    try:
        if stage:
            incoming.write.option("compression", "zstd").parquet(stage)
            incoming = spark.read.parquet(stage)
        _swap_in(path, incoming, keys)
    finally:
        discard(spark, *([stage] if stage else []))


def _swap_in(path: str, fresh: DataFrame, keys: list[str]) -> None:
    spark = fresh.sparkSession
    require_none(
        fresh.groupBy(*keys).count().filter("count > 1"), f"duplicate keys for {path}"
    )
    stored = read_table(spark, path, T.StructType([fresh.schema[c] for c in PARTITIONS]))
    if stored is None:
        merged = fresh
    else:
        touched = fresh.select(*PARTITIONS).distinct()
        held = stored.join(touched, list(PARTITIONS), "left_semi")
        stays = held.select(*keys).join(fresh.select(*keys), keys, "left_anti")
        merged = fresh if stays.isEmpty() else upsert_rows(held, fresh, keys)
        # columns that only stored rows have stay, as unionByName keeps them
        merged = merged.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema if f.name not in merged.columns])
    (
        merged.hint("rebalance", *PARTITIONS)  # AQE splits a hot partition, merges small ones
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def drop_collection(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """All tables without one collection's rows (collections keyed by name)."""
    out = {}
    for table, df in tables.items():
        column = "name" if table == "collections" else "collection"
        out[table] = df.filter(F.col(column) != name)
    return out


def collection_drift(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forbidden changes of existing collections: (name, problem).

    Model, dimension and schema may not change; the community may go from unset to
    set but not elsewhere; the display name may change.
    """
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    both = incoming.join(old, F.col("name") == F.col("old_name"))

    def changed(column: str) -> Column:
        return ~F.col(column).eqNullSafe(F.col(f"old_{column}"))

    moved = (
        F.col("community_id").isNotNull() & F.col("old_community_id").isNotNull()
        & changed("community_id")
    )
    checks = F.array(
        F.when(moved, "community_moved"),
        F.when(changed("embedding_model_id"), "model_mismatch"),
        F.when(changed("embedding_dimension"), "dimension_mismatch"),
        F.when(changed("metadata_schema"), "schema_changed"),
    )
    return both.select("name", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def merge_collections(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accepted update: new rows, filled community, current display name."""
    old = stored.select("name", F.col("community_id").alias("_c"))
    filled = incoming.join(old, "name", "left").withColumn(
        "community_id", F.coalesce("community_id", "_c")
    ).drop("_c")
    return upsert_rows(stored, filled, ["name"])


def get_or_create_papers(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Papers plus the (collection, source_pdf) pairs seen first in ``chunks``."""
    seen = chunks.select("collection", "source_pdf").distinct().withColumn(
        "paper_id", F.sha2(F.concat_ws("\u0001", "collection", "source_pdf"), 256)
    )
    return insert_missing(papers, seen, ["collection", "source_pdf"])


def ensure_memberships(memberships: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, community) pairs become active memberships; others stay as they are."""
    incoming = pairs.select("user_id", "community_id").distinct().join(
        memberships.select("user_id", "community_id", "role"), ["user_id", "community_id"], "left"
    ).select(
        "user_id", "community_id", F.coalesce("role", F.lit("member")).alias("role"),
        F.lit("active").alias("status"),
    )
    return upsert_rows(
        memberships.select("user_id", "community_id", "role", "status"), incoming,
        ["user_id", "community_id"],
    )


def upsert_domain_rules(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert a rule or update its match_mode and is_active."""
    return upsert_rows(rules, incoming, ["community_id", "domain"])
