"""Indexing: chunks -> metadata, media keys, vectors -> keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.metadata import (
    embedding_text,
    metadata_summary,
    project_chunk_metadata,
    typed_value,
)
from paperfold.functions.providers import dimension_violations
from paperfold.operators.artifacts import map_media
from paperfold.operators.quality import duplicates
from paperfold.operators.upsert import bucket_of, require_none, upsert_table
from paperfold.session import discard, fresh_dir, small_batches


def index_rows(chunks: DataFrame, collection: str | Column, schema: list[dict], embedder,
               model_id: str) -> DataFrame:
    """Chunk rows -> stored rows: metadata JSON, embedding text's vector, bucket."""
    small_batches(chunks.sparkSession)
    name = F.lit(collection) if isinstance(collection, str) else collection
    df = chunks.withColumn("metadata_json", project_chunk_metadata(schema))
    df = df.withColumn("embed_text", embedding_text(
        F.col("text"), metadata_summary(schema, "metadata_json")
    ))
    return df.select(
        name.alias("collection"),
        F.col("id").alias("chunk_id"),
        "chunk_level", "parent_chunk_id", "sub_question_label", "text", "source_pdf",
        F.col("metadata_json").alias("metadata"),
        "render_blocks", "media",
        embedder(F.col("embed_text")).alias("embedding"),
        F.lit(model_id).alias("embedding_model_id"),
    ).withColumn("bucket", bucket_of("chunk_id"))


def attach_object_keys(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Give every media reference its object key; any violation stops the job."""
    media = chunks.select("id", "source_pdf", F.posexplode("media").alias("pos", "m")).select(
        F.col("id").alias("chunk_id"), "source_pdf", "pos", "m.*"
    )
    mapped, bad = map_media(media, artifacts)
    require_none(bad, "media without object key")
    names = chunks.schema["media"].dataType.elementType.names
    back = mapped.groupBy("chunk_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*names).alias("m")))),
        lambda x: x["m"],
    ).alias("_media"))
    return chunks.join(
        back.withColumnRenamed("chunk_id", "id"), "id", "left"
    ).withColumn("media", F.coalesce("_media", "media")).drop("_media")


def index_chunks(chunks: DataFrame, collection: str | Column, schema: list[dict], embedder,
                 model_id: str, dimension: int, root: str,
                 artifacts: DataFrame | None = None) -> None:
    """Index a batch of chunks into {root}/chunks and {root}/vectors.

    The rows are staged once in the shared folder, so the two upserts do not chunk and
    embed twice, and a lost executor re-reads files instead of recomputing. The stage is
    deleted once both tables are written.
    """
    spark = chunks.sparkSession
    if artifacts is not None:
        chunks = attach_object_keys(chunks, artifacts)
    stage = fresh_dir(spark, "index")
    try:
        index_rows(chunks, collection, schema, embedder, model_id).write.option("compression", "zstd").parquet(stage)
        rows = spark.read.parquet(stage)
        require_none(
            rows.filter(dimension_violations("embedding", dimension)).select("chunk_id"),
            "embedding dimension mismatch",
        )
        require_none(duplicates(rows, ["collection", "chunk_id"]), "duplicate chunk ids")
        keys = ["collection", "bucket", "chunk_id"]
        upsert_table(f"{root}/chunks", rows.drop("embedding", "embedding_model_id"), keys, staged=True)
        vectors = rows.select(
            *keys, "chunk_level", "source_pdf",
            *[typed_value("metadata", f["key"], f["type"]).alias(f["key"]) for f in schema
              if f["key"] not in ("chunk_level", "source_pdf")],
            "embedding", "embedding_model_id",
        )
        upsert_table(f"{root}/vectors", vectors, keys, staged=True)
    finally:
        discard(spark, stage)
