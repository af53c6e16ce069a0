"""Search over a whole table of queries: validate, top-k, rerank, threshold, limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperfold.operators import vector_search as V
from paperfold.operators.filters import filter_violations, request_reject_reason
from paperfold.schemas import CHUNK_LEVELS

Reranker = Callable[[Column, Column], Column]
MAX_FOUND = 200_000
MAX_COLLECTIONS = 50_000


def small(df: DataFrame, most: int = MAX_COLLECTIONS) -> DataFrame:
    """Broadcast if it has at most ``most`` rows (counted, up to one more): a join on a few
    collection names would otherwise put all rows of a collection in one task."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def split_valid(queries: DataFrame, schema_fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid queries, rejects with reason): limits first, then filter conditions."""
    limits = queries.withColumn("reason", request_reject_reason(
        F.col("query"), F.col("limit"), F.col("rerank")
    ))
    bad = filter_violations(queries, schema_fields).groupBy("query_id").agg(
        F.min("reason").alias("filter_reason")
    )
    checked = limits.join(bad, "query_id", "left").withColumn(
        "reason", F.coalesce("reason", "filter_reason")
    ).drop("filter_reason")
    rejects = checked.filter(F.col("reason").isNotNull()).select("query_id", "reason")
    return checked.filter(F.col("reason").isNull()).drop("reason"), rejects


def search_checked(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, schema_fields: DataFrame,
                   collections: DataFrame, reranker: Reranker | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejects): queries are checked before any vector is read.

    A query is rejected (query_id, reason) for a limit, for a filter against the schema, for
    a collection that doesn't exist, and for a vector of another dimension than its
    collection's; the others run. collections: as for ``search``, with embedding_dimension
    and embedding_model_id (vectors of other models are left out).
    """
    valid, rejects = split_valid(queries, schema_fields)
    known = small(collections.select(F.col("name").alias("collection"), "embedding_dimension", "embedding_model_id"))
    df = valid.join(known, "collection", "left").withColumn("reason", (
        F.when(F.col("embedding_dimension").isNull(), "collection_not_found")
        .when(F.size("vector") != F.col("embedding_dimension"), "dimension_mismatch")
    ))
    rejects = rejects.unionByName(df.filter(F.col("reason").isNotNull()).select("query_id", "reason"))
    runnable = df.filter(F.col("reason").isNull()).select(*queries.columns)
    current = vectors.join(known.select("collection", "embedding_model_id"), ["collection", "embedding_model_id"], "left_semi")
    return search(runnable, current, chunks, collections, reranker), rejects


def candidates(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, vec_rank) with the over-fetch depth applied."""
    asked = queries.select(
        "query_id", "collection", "vector",
        V.candidate_depth(F.col("limit"), F.col("rerank")).alias("k"),
        V.filters_json("filters").alias("filters"),
    )
    return V.top_k_batch(vectors, asked)


def passes_threshold(score: Column, minimum: Column) -> Column:
    """score >= minimum; no minimum keeps all; NaN never passes; a non-finite minimum
    is an error."""
    broken = F.isnan(minimum) | (F.abs(minimum) == float("inf"))
    return (
        F.when(minimum.isNull(), True)
        .when(broken, F.raise_error(F.lit("retrieval threshold must be finite")).cast("boolean"))
        .otherwise(F.coalesce((score >= minimum) & ~F.isnan(score), F.lit(False)))
    )


def search(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    collections: DataFrame | None = None,
    reranker: Reranker | None = None,
    model_id: str | None = None,
) -> DataFrame:
    """Ranked results of every query.

    queries: query_id, query, collection, vector, filters array<FILTER>, limit, rerank.
    collections (name, vector_min_score, rerank_min_score): thresholds, when given.
    Wide columns (text, blocks, media) join back only after the top-k: while the asked
    depths sum to at most MAX_FOUND rows (taken first), what was found is broadcast, so the
    chunk table is read where it lies. ``model_id`` keeps other models' vectors out.
    """
    if model_id is not None:
        vectors = vectors.filter(F.col("embedding_model_id") == model_id)
    found = candidates(queries, vectors)
    asked = queries.select(
        F.col("query_id").cast("string").alias("query_id"), "query", "collection", "limit", "rerank"
    )
    found = found.join(asked, "query_id")
    depth = queries.agg(F.sum(V.candidate_depth(F.col("limit"), F.col("rerank")))).first()[0] or 0
    df = (F.broadcast(found) if depth <= MAX_FOUND else found).join(chunks, ["collection", "chunk_id"])
    reranked = F.col("rerank") & F.lit(reranker is not None)
    if reranker is not None:
        second = F.when(F.col("rerank"), reranker(F.col("query"), F.col("text")))
        df = df.withColumn("_second", second).withColumn(
            "score", F.when(F.col("rerank"), F.col("_second")).otherwise(F.col("score"))
        )
    df = df.filter(F.col("chunk_level").isin(*CHUNK_LEVELS))
    first = F.when(reranked, F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")))
    w = W.partitionBy("query_id").orderBy(
        F.coalesce(first, F.lit(0.0)).desc(), F.col("vec_rank").asc()
    )
    df = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("limit"))
    # Rows above the threshold are a prefix of this ranking, so it applies after the
    # rank; below the window it would make Spark compute the rerank score twice.
    drop = ["limit", "rerank", "query"] + (["_second"] if reranker is not None else [])
    if collections is not None:
        limits = collections.select(
            F.col("name").alias("collection"), "vector_min_score", "rerank_min_score"
        )
        df = df.join(small(limits), "collection", "left")
        minimum = F.when(reranked, F.col("rerank_min_score")).otherwise(F.col("vector_min_score"))
        df = df.filter(passes_threshold(F.col("score"), minimum))
        drop += ["vector_min_score", "rerank_min_score"]
    return df.drop(*drop)


def response_totals(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Rows returned per query, zero for a query that found nothing."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return queries.select(F.col("query_id").cast("string").alias("query_id")).join(
        n, "query_id", "left"
    ).select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def planned_queries(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """Replace each query's text by its plan's first semantic query; filters unchanged."""
    first = plans.select(
        F.col("query_id"), F.get("semantic_queries", F.lit(0)).alias("_planned")
    )
    return queries.join(first, "query_id", "left").withColumn(
        "query", F.coalesce("_planned", "query")
    ).drop("_planned")


def authorized_only(queries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep queries whose (user, collection) pair is allowed to read."""
    return queries.join(allowed.select("user_id", "collection").distinct(),
                        ["user_id", "collection"], "left_semi")


def chunk_lookup(keys: DataFrame, chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """Batch point lookup: chunk, its parent's text, and a status per key.

    keys: collection, chunk_id. A missing collection differs from a missing chunk. Rows
    without a parent match nothing, so they are dealt out by their own key instead of all
    going where a missing value hashes to; collection names are broadcast, or a join on them
    would put all rows and parent texts of a collection in one task.
    """
    def slot(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << 31))

    parents = chunks.select(
        "collection", F.col("chunk_id").alias("parent_chunk_id"),
        F.col("text").alias("parent_text"), slot("chunk_id").alias("_slot"),
    )
    found = keys.join(chunks, ["collection", "chunk_id"], "left").withColumn(
        "_slot", F.when(F.col("parent_chunk_id").isNull(), -1 - slot("chunk_id")).otherwise(slot("parent_chunk_id"))
    ).join(parents, ["collection", "parent_chunk_id", "_slot"], "left").drop("_slot")
    known = collections.select(
        F.col("name").alias("collection"), F.lit(True).alias("_known")
    )
    status = (
        F.when(F.col("_known").isNull(), "collection_not_found")
        .when(F.col("chunk_level").isNull(), "chunk_not_found")
        .otherwise("ok")
    )
    return found.join(small(known), "collection", "left").withColumn("status", status).drop("_known")
