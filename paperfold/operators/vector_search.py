"""Exact cosine top-k, for one query or for a whole table of queries.

Single query: a JVM expression and ORDER BY ... LIMIT (TakeOrderedAndProject).

Query table: every vector is read once. Up to ``MAX_BROADCAST_QUERIES`` queries
(count and bytes are taken in Spark before anything is pulled) are broadcast, one
matrix per collection; each vector partition keeps a running top-k per query, so only
k rows per query and partition are shuffled. A larger table goes over a grid of (query
block, vector block) groups of one collection, each of bounded size, with the same
kernel. Both give the same exact result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.text import as_col

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
QUERY_BLOCK = 2048
VECTOR_BLOCK = 16384
MAX_FILTER_SETS = 64  # so many distinct filter sets are pushed to the scan as one predicate
SCORE_CELLS = 1 << 20  # so many scores are held at once, whatever the sizes of batch and query set
SCORE_DIGITS = 12  # equal vectors must tie whatever order the sums were taken in
CANDIDATES = T.StructType().add("query_id", T.StringType()).add(
    "chunk_id", T.StringType()
).add("score", T.DoubleType()).add("k", T.IntegerType())


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two float arrays, summed in double; NaN for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda acc, v: acc + v,
        )

    left, right = as_col(a), as_col(b)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm == 0, float("nan")).otherwise(dot(left, right) / norm)


def top_k_single(vectors: DataFrame, query: list[float], k: int,
                 condition: Column | None = None) -> DataFrame:
    """Filtered exact top-k of one query: rank-ready rows (chunk_id, score)."""
    if k <= 0:
        raise ValueError("limit must be positive")
    if condition is not None:
        vectors = vectors.filter(condition)
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(
        "chunk_id",
        F.when(F.size("embedding") == len(query), F.round(cosine("embedding", literal), SCORE_DIGITS))
        .otherwise(F.raise_error(F.lit("query dimension mismatch")).cast("double"))
        .alias("score"),
    )
    order = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    return scored.orderBy(order.desc(), F.col("chunk_id").asc()).limit(k)


def candidate_depth(limit: Column, rerank: Column) -> Column:
    """min(3 * limit, 50) when rerank is asked for, else the limit."""
    return F.when(rerank, F.least(limit * 3, F.lit(50))).otherwise(limit)


def normalise(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return wide / norms[:, None]


class QuerySet:
    """Query vectors with their collections, depths and filter sets."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids = rows["query_id"].astype(str).to_numpy()
        self.k = rows["k"].to_numpy(dtype=np.int64)
        # collection -> filter list -> positions of the queries that share both
        self.groups: dict[str, dict[str, list[int]]] = {}
        for i, (collection, filters) in enumerate(zip(rows["collection"], rows["filters"])):
            self.groups.setdefault(collection, {}).setdefault(filters, []).append(i)
        # a matrix per group: collections may differ in dimension
        vectors = [np.asarray(v) for v in rows["vector"]]
        self.matrix = {
            (collection, filters): normalise(np.stack([vectors[i] for i in members]))
            for collection, sets in self.groups.items() for filters, members in sets.items()
        }

    def score(self, batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query: its best chunk ids and scores within one batch of vectors."""
        if batch.empty:
            return
        ids = np.asarray(batch["chunk_id"].astype(str), dtype=object)
        for collection, at in batch.groupby("collection").indices.items():
            if collection not in self.groups:
                continue
            own = normalise(np.stack([np.asarray(v) for v in batch["embedding"].iloc[at]]))
            unit = np.zeros((len(batch), own.shape[1]))
            unit[at] = own
            for filters, members in self.groups[collection].items():
                rows = at
                for item in json.loads(filters):
                    rows = rows[matches(batch[item["field"]].iloc[rows], item)]
                if len(rows) == 0:
                    continue
                matrix = self.matrix[collection, filters]
                if matrix.shape[1] != unit.shape[1]:
                    raise ValueError("query dimension mismatch")
                wide, named = unit[rows], ids[rows]
                step = max(1, SCORE_CELLS // len(rows))
                for first in range(0, len(members), step):
                    scores = np.round(wide @ matrix[first:first + step].T, SCORE_DIGITS)
                    for j, q in enumerate(members[first:first + step]):
                        keep = best(scores[:, j], named, int(self.k[q]))
                        yield q, named[keep], scores[keep, j]


def matches(values: pd.Series, item: dict) -> np.ndarray:
    """Mask of one condition over a typed column; missing values never match."""
    present = values.notna().to_numpy()
    out = np.zeros(len(values), dtype=bool)
    if present.any():
        have = values[present]
        wanted = item["value"]
        hit = {
            "eq": have.__eq__, "gte": have.__ge__, "lte": have.__le__
        }[item["op"]](wanted)
        out[present] = hit.to_numpy(dtype=bool)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by score, ties by id; NaN ranks last. All ties at the
    cut are looked at, so none is lost."""
    key = np.where(np.isnan(scores), -np.inf, scores)
    rows = np.arange(len(key))
    if len(key) > k:
        cut = np.partition(key, len(key) - k)[len(key) - k]
        rows = np.flatnonzero(key >= cut)
    order = np.lexsort((ids[rows].astype(str), -key[rows]))
    return rows[order[:k]]


def _emit(queries: QuerySet | None, held: dict) -> pd.DataFrame:
    """Held lists as one frame. Text columns stay plain object arrays: Arrow then
    makes one contiguous array of them, as Spark expects."""
    sizes = [len(ids) for ids, _ in held.values()]
    members = list(held)
    rows = np.repeat(np.array(members, dtype=np.int64), sizes)

    def joined(parts: list, dtype) -> np.ndarray:
        return np.concatenate(parts).astype(dtype) if parts else np.array([], dtype=dtype)

    ids = joined([i for i, _ in held.values()], object)
    scores = joined([s for _, s in held.values()], np.float64)
    asked = queries.ids[rows].astype(object) if members else ids
    depth = queries.k[rows] if members else np.array([], dtype=np.int64)
    return pd.DataFrame({
        "query_id": pd.Series(asked, dtype=object), "chunk_id": pd.Series(ids, dtype=object),
        "score": scores, "k": depth,
    })


def _merge(queries: QuerySet, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Running top-k per query over the batches of one task (at most k rows each)."""
    held: dict = {}
    for batch in batches:
        for q, ids, scores in queries.score(batch):
            if q in held:
                ids = np.concatenate([held[q][0], ids])
                scores = np.concatenate([held[q][1], scores])
                keep = best(scores, ids, int(queries.k[q]))
                ids, scores = ids[keep], scores[keep]
            held[q] = (ids, scores)
    return _emit(queries, held)


def top_k_batch(
    vectors: DataFrame,
    queries: DataFrame,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Exact top-k of every query: (query_id, chunk_id, score), at most k rows each.

    vectors: collection, chunk_id, embedding and one typed column per filter field.
    queries: query_id, collection, vector, k, filters (JSON list of conditions whose
    values carry their JSON type). Filters apply before the top-k.
    """
    spark = vectors.sparkSession
    queries = queries.select(
        F.col("query_id").cast("string").alias("query_id"), "collection",
        F.col("vector").cast("array<double>").alias("vector"), F.col("k").cast("int").alias("k"),
        "filters",
    )
    n, size, deepest = queries.limit(max_broadcast + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)), F.max("k")
    ).first()
    if n <= max_broadcast and size <= MAX_BROADCAST_BYTES:
        head = queries.toPandas()
        if head.empty:
            return keep_top(spark.createDataFrame([], CANDIDATES), 1)
        shared = spark.sparkContext.broadcast(head)
        scoped = pushed(vectors, head)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield _merge(QuerySet(shared.value), batches)

        return keep_top(scoped.mapInPandas(scan, CANDIDATES), int(deepest))
    deepest = queries.agg(F.max("k")).first()[0]
    return keep_top(_grid(vectors, queries), deepest)


def pushed(vectors: DataFrame, head: pd.DataFrame) -> DataFrame:
    """The vectors that some query may ask for, with the columns that the queries name.

    The collections are a literal list, for static partition pruning; where every query
    filters, the scan also gets the disjunction of their filter sets.
    """
    sets = [json.loads(f) for f in sorted(set(head["filters"]))]
    fields = sorted({item["field"] for items in sets for item in items})
    scoped = vectors.filter(F.col("collection").isin(sorted(set(head["collection"]))))
    if all(sets) and len(sets) <= MAX_FILTER_SETS:
        def condition(item: dict) -> Column:
            c = F.col(item["field"])
            return {"eq": c.__eq__, "gte": c.__ge__, "lte": c.__le__}[item["op"]](F.lit(item["value"]))

        any_set = F.lit(False)
        for items in sets:
            every = F.lit(True)
            for item in items:
                every = every & condition(item)
            any_set = any_set | every
        scoped = scoped.filter(any_set)
    own = ("collection", "chunk_id", "embedding")
    return scoped.select(*own, *[f for f in fields if f not in own])


def _grid(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(collection, query block, vector block) groups: a query meets the vectors of its own
    collection only. Blocks are hash-salted, so a hot collection spreads over many tasks;
    how many a collection needs is counted in a DataFrame."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    shape = blocks(queries, QUERY_BLOCK, "_nq").join(blocks(vectors, VECTOR_BLOCK, "_nv"), "collection")
    q = queries.join(shape, "collection").withColumn("_q", F.pmod(F.xxhash64("query_id"), "_nq").cast("int"))
    q = q.withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("_nv") - 1)))
    v = vectors.join(shape, "collection").withColumn("_v", F.pmod(F.xxhash64("chunk_id"), "_nv").cast("int"))
    v = v.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    by = ["collection", "_q", "_v"]

    def block(q_rows: pd.DataFrame, v_rows: pd.DataFrame) -> pd.DataFrame:
        if q_rows.empty or v_rows.empty:
            return _emit(None, {})
        return _merge(QuerySet(q_rows), iter([v_rows]))

    return q.drop("_nq", "_nv").groupBy(*by).cogroup(v.drop("_nq", "_nv").groupBy(*by)).applyInPandas(block, CANDIDATES)


def score_order(score: str = "score") -> Column:
    """Descending score with NaN last (Spark itself would sort NaN first)."""
    return F.when(F.isnan(score), float("-inf")).otherwise(F.col(score)).desc()


def keep_top(partial: DataFrame, deepest: int) -> DataFrame:
    """Merge the per-task lists. ``deepest`` is the largest k: a literal bound, so the
    window plans a group limit before its shuffle. On a wide cluster a query's many
    short lists are first cut within salted groups, so no single task sorts them all.
    """
    df = partial
    fanout = partial.sparkSession.sparkContext.defaultParallelism // 64
    by = [score_order(), F.col("chunk_id")]
    if fanout > 1:
        df = df.withColumn("_s", F.pmod(F.xxhash64("chunk_id"), F.lit(fanout)))
        salted = W.partitionBy("query_id", "_s").orderBy(*by)
        df = df.withColumn("_r", F.row_number().over(salted)).filter(
            F.col("_r") <= deepest
        ).drop("_r", "_s")
    w = W.partitionBy("query_id").orderBy(*by)
    return (
        df.withColumn("vec_rank", F.row_number().over(w))
        .filter(F.col("vec_rank") <= deepest)
        .filter(F.col("vec_rank") <= F.col("k"))
        .drop("k")
    )


def filters_json(filters: Column | str) -> Column:
    """array<FILTER> -> JSON list with typed values, the form the kernel reads."""
    def one(f: Column) -> Column:
        quoted = F.to_json(F.array(f["value"]))
        value = F.when(
            f["value_type"] == "string",
            F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        ).otherwise(f["value"])
        return F.concat(
            F.lit('{"field":"'), f["field"], F.lit('","op":"'), f["op"],
            F.lit('","value":'), value, F.lit("}"),
        )

    listed = F.array_join(F.transform(as_col(filters), one), ",")
    return F.concat(F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]"))
