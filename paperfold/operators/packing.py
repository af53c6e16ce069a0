"""Parent/child dedup, greedy budget packing and context text for ranked results.

Every group here is one query's result list, which the search limit bounds (<= 50),
so collecting it into an array is bounded too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.metadata import metadata_lines
from paperfold.functions.text import bind, token_estimate, truncate_to_tokens

CONTEXT_BUDGET = 4000
SINGLE_CHUNK_CAP = 1200


def as_lists(results: DataFrame) -> DataFrame:
    """One row per query: its results in rank order as an array of structs."""
    own = [c for c in results.columns if c not in ("query_id", "rank")]
    return results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", *[
            c for c in own if c != "chunk_id"
        ])), _by_rank).alias("items")
    )


def _by_rank(x: Column, y: Column) -> Column:
    return F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0)


def from_lists(lists: DataFrame, *extra: str) -> DataFrame:
    return lists.select("query_id", *extra, F.inline("items"))


def dedupe_parent_child(results: DataFrame) -> DataFrame:
    """Of a sub-question and its parent in the same list keep the better one; a tie
    drops the sub-question. All decisions look at the original list.

    Decided inside the list: the results are shuffled once and never joined to
    themselves, so the search that made them runs once.
    """
    def keep(items: Column, x: Column) -> Column:
        is_sub = x["chunk_level"] == "sub_question"
        beaten_by_parent = F.exists(items, lambda p: F.coalesce(
            is_sub & (p["chunk_id"] == x["parent_chunk_id"]) & ~(x["score"] > p["score"]),
            F.lit(False),
        ))
        beaten_by_child = F.exists(items, lambda c: F.coalesce(
            (c["chunk_level"] == "sub_question") & (c["parent_chunk_id"] == x["chunk_id"])
            & (c["score"] > x["score"]),
            F.lit(False),
        ))
        return ~beaten_by_parent & ~beaten_by_child

    kept = bind(lambda s: F.filter(s["items"], lambda x: keep(s["items"], x)), "items")
    return from_lists(as_lists(results).select("query_id", kept.alias("items"))).select(
        *results.columns
    )


def single_cap(setting: int, budget: int) -> int:
    return min(setting, max(1, budget - 1))


def pack(results: DataFrame, budget: int = CONTEXT_BUDGET, cap: int = SINGLE_CHUNK_CAP,
         estimator=token_estimate, truncate=truncate_to_tokens) -> DataFrame:
    """Greedy packing in rank order, per query. An item that does not fit is left out
    and scanning goes on, so a running sum would be wrong: a fold decides.

    Adds packed_text, tokens, truncated, packed, status per result row.
    """
    oversize = estimator(F.col("text")) > cap
    sized = results.withColumn("truncated", oversize).withColumn(
        "packed_text", F.when(oversize, truncate(F.col("text"), cap)).otherwise(F.col("text"))
    ).withColumn("tokens", estimator(F.col("packed_text")))
    lists = as_lists(sized)
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept")
    )

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x["rank"].cast("int"))))
            .otherwise(acc["kept"]).alias("kept"),
        )

    lists = lists.withColumn(
        "kept", F.aggregate("items", start, step, lambda acc: acc["kept"])
    )
    return from_lists(lists, "kept").withColumn(
        "packed", F.array_contains("kept", F.col("rank").cast("int"))
    ).withColumn(
        "status", F.when(F.size("kept") == 0, "context_pack_failed").otherwise("ok")
    ).drop("kept")


def packing_summary(packed: DataFrame) -> DataFrame:
    """Per query: packed, omitted and truncated ids in rank order, tokens used, status."""
    def ids(condition: Column) -> Column:
        hits = F.array_sort(F.collect_list(F.when(condition, F.struct("rank", "chunk_id"))))
        return F.transform(hits, lambda x: x["chunk_id"])

    return packed.groupBy("query_id").agg(
        ids(F.col("packed")).alias("context_chunk_ids"),
        ids(~F.col("packed")).alias("omitted_chunk_ids"),
        ids(F.col("truncated")).alias("truncated_chunk_ids"),
        F.sum(F.when(F.col("packed"), F.col("tokens")).otherwise(0)).alias("used_tokens"),
        F.first("status").alias("status"),
    )


def context_text(packed: DataFrame, schema: list[dict]) -> DataFrame:
    """Per query, the numbered source blocks of its packed chunks as one text."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("rank")
    rows = packed.filter("packed").withColumn("n", F.row_number().over(w))
    lines = metadata_lines(schema, "metadata")
    body = F.concat(
        F.lit("[SOURCE "), F.col("n").cast("string"), F.lit("]\nchunk_id: "), F.col("chunk_id"),
        F.lit("\nchunk_level: "), F.col("chunk_level"),
        F.lit("\nscore: "),
        # half-even on the exact binary value, as the published context texts use
        F.call_function("format_number", F.col("score"), F.lit("#0.0000")),
        F.when(lines != "", F.concat(F.lit("\n"), lines)).otherwise(""),
        F.lit("\n\ntext:\n"), F.col("packed_text"),
    )
    blocks = rows.select("query_id", "n", body.alias("body"))
    return blocks.groupBy("query_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]),
        "\n\n",
    ).alias("context"))
