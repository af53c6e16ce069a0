"""Expectations: table constraints, render-block validity, uniqueness and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.blocks import block_problem
from paperfold.functions.keys import valid_key
from paperfold.functions.text import is_finite, strip
from paperfold.schemas import MEDIA_KINDS, MEDIA_RELATIONS

SAMPLE = 5
MEDIA_FORBIDDEN = ("file_path", "access_url")
MEDIA_ALLOWED = (
    "media_id", "kind", "relation", "object_key", "page_number", "bbox", "owner_level",
    "owner_label", "order_index", "text_payload", "description",
)


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once. Partial aggregation absorbs a hot key."""
    if where is not None:
        df = df.filter(where)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent.select(*on), on, "left_anti")


def missing_parents(chunks: DataFrame) -> DataFrame:
    """Sub-questions whose parent is not in the same collection."""
    subs = chunks.filter(F.col("chunk_level") == "sub_question")
    parents = chunks.select("collection", F.col("chunk_id").alias("parent_chunk_id"))
    return subs.join(parents, ["collection", "parent_chunk_id"], "left_anti")


def check_failures(df: DataFrame, checks: dict[str, Column], key: list[str]) -> DataFrame:
    """Rows failing row-level CHECKs: key columns and the check's name."""
    failed = F.array(*[
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()
    ])
    return df.select(*key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("check"))


def user_checks() -> dict[str, Column]:
    return {"email_normalised": F.col("email") == F.lower(strip("email"))}


def membership_checks() -> dict[str, Column]:
    return {
        "role": F.col("role").isin("member", "admin"),
        "status": F.col("status").isin("active", "inactive"),
    }


def render_block_problems(chunks: DataFrame) -> DataFrame:
    """(chunk_id, block_index, problem) of every invalid block."""
    return chunks.filter(F.col("render_blocks").isNotNull()).select(
        "chunk_id", F.posexplode("render_blocks").alias("block_index", "b")
    ).select("chunk_id", "block_index", block_problem(F.col("b")).alias("problem")).filter(
        F.col("problem").isNotNull()
    )


def empty_with_text(chunks: DataFrame) -> DataFrame:
    """Chunks that have text but no render block."""
    no_blocks = F.col("render_blocks").isNull() | (F.size("render_blocks") == 0)
    return chunks.filter((F.length(F.trim("text")) > 0) & no_blocks)


def render_block_summary(chunks: DataFrame) -> DataFrame:
    no_blocks = F.col("render_blocks").isNull() | (F.size("render_blocks") == 0)
    return chunks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("render_blocks").isNull()).alias("null_blocks"),
        F.count_if((F.length(F.trim("text")) > 0) & no_blocks).alias("empty_with_text"),
    )


def bounded_sample(violations: DataFrame, order: str, n: int = SAMPLE) -> DataFrame:
    """The report's sample: the first n by key (TakeOrderedAndProject)."""
    return violations.orderBy(order).limit(n)


def index_permutation(df: DataFrame, group: list[str], index: str = "index") -> DataFrame:
    """Groups whose indices are not 0..n-1 exactly once.

    n rows, all distinct, lowest 0, highest n-1. Distinctness is checked on
    pre-aggregated (group, index) pairs, so one big group spreads over the cluster.
    """
    pairs = df.groupBy(*group, index).agg(F.count(F.lit(1)).alias("_n"))
    stats = pairs.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.max("_n").alias("most"),
        F.min(index).alias("lo"), F.max(index).alias("hi"),
    )
    return stats.filter(
        (F.col("most") > 1) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
    ).select(*group, "n")


def media_ref_problem(raw: Column | str) -> Column:
    """Why a media reference (JSON object text) may not be stored; NULL when fine."""
    ref = F.col(raw) if isinstance(raw, str) else raw
    keys = F.json_object_keys(ref)

    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    def text(name: str) -> Column:
        return F.get_json_object(ref, f"$.{name}")

    v = F.try_parse_json(ref)

    def kind(name: str) -> Column:
        return F.coalesce(
            F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("MISSING")
        )

    nullish = ("VOID", "MISSING")
    bbox = F.from_json(text("bbox"), "array<double>")
    bbox_ok = (
        (F.size(bbox) == 4) & F.forall(bbox, is_finite)
        & kind("bbox").rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL.*)>$")
    )

    def whole(name: str, least: int) -> Column:
        return (kind(name) == "BIGINT") & (text(name).try_cast("bigint") >= least)

    def optional(name: str, ok: Column) -> Column:
        return ~kind(name).isin(*nullish) & ~F.coalesce(ok, F.lit(False))

    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in MEDIA_ALLOWED])))
    return (
        F.when(keys.isNull(), "not_an_object")
        .when(has("file_path") | has("access_url"), "forbidden_field")
        .when(unknown > 0, "unknown_field")
        .when((kind("media_id") != "STRING") | (text("media_id") == ""), "bad_media_id")
        .when(~F.coalesce(text("kind").isin(*MEDIA_KINDS), F.lit(False)), "bad_kind")
        .when(~F.coalesce(text("relation").isin(*MEDIA_RELATIONS), F.lit(False)), "bad_relation")
        .when(optional("object_key", (kind("object_key") == "STRING") & valid_key(text("object_key"))),
              "bad_object_key")
        .when(optional("page_number", whole("page_number", 1)), "bad_page_number")
        .when(optional("bbox", bbox_ok), "bad_bbox")
        .when(has("owner_level") & ((kind("owner_level") != "STRING") | (text("owner_level") == "")),
              "bad_owner_level")
        .when(optional("owner_label", kind("owner_label") == "STRING"), "bad_owner_label")
        .when(optional("order_index", whole("order_index", 0)), "bad_order_index")
        .when(optional("text_payload", kind("text_payload") == "STRING"), "bad_text_payload")
        .when(optional("description", kind("description") == "STRING"), "bad_description")
    )


def readable_media_ref(raw: Column | str) -> Column:
    """Lenient check on read: identity fields and key only; a bad ref is dropped."""
    ref = F.col(raw) if isinstance(raw, str) else raw
    keys = F.json_object_keys(ref)
    key = F.get_json_object(ref, "$.object_key")
    return F.coalesce(
        ~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in MEDIA_FORBIDDEN]))
        & (F.get_json_object(ref, "$.media_id") != "")
        & F.get_json_object(ref, "$.kind").isin(*MEDIA_KINDS)
        & F.get_json_object(ref, "$.relation").isin(*MEDIA_RELATIONS)
        & (key.isNull() | valid_key(key)),
        F.lit(False),
    )


def unknown_media_chunks(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk ids that own media references but are not in the chunk set."""
    return media.select("chunk_id").join(
        chunks.select("chunk_id"), "chunk_id", "left_anti"
    ).distinct()
