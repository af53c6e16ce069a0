"""Answer drafts: schema checks, citation resolution and source cards.

A draft holds at most 5 patterns of 5 ids and 10 sources, and a request at most 50
valid ids, so everything about one draft is decided inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperfold.functions.blocks import excerpt_blocks
from paperfold.functions.text import excerpt, let
from paperfold.schemas import ANSWER_DRAFT, DRAFT_STATUSES

# Texts shown to the reader.
PARTIAL_LIMITATION = (
    "Some generated citations were removed because they did not match the "
    "retrieved sources."
)
CASCADE_LIMITATION = "Generated citations did not match retrieved sources."
EXCERPT_CHARS = 500
MAX_LIMITATIONS = 5


def parse_draft(raw: Column) -> Column:
    return F.from_json(raw, ANSWER_DRAFT)


def extra_keys(raw: Column, allowed: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(raw)
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))


def draft_problems(raw: str = "raw", draft: str = "draft") -> Column:
    """Every violated constraint of a draft, as an array of names."""
    d = F.col(draft)
    patterns = F.coalesce(d["patterns"], F.array().cast(ANSWER_DRAFT["patterns"].dataType))
    sources = F.coalesce(d["cited_sources"], F.array().cast(ANSWER_DRAFT["cited_sources"].dataType))
    entries = F.from_json(
        F.get_json_object(F.col(raw), "$.patterns"), "array<map<string,string>>"
    )
    source_entries = F.from_json(
        F.get_json_object(F.col(raw), "$.cited_sources"), "array<map<string,string>>"
    )

    def stray(items: Column, names: tuple[str, ...]) -> Column:
        allowed = F.array(*[F.lit(n) for n in names])
        return F.exists(items, lambda m: F.size(F.array_except(F.map_keys(m), allowed)) > 0)

    checks = [
        (d.isNull() | F.json_object_keys(raw).isNull(), "not_an_object"),
        (extra_keys(F.col(raw), (
            "answer_status", "overview", "patterns", "cited_sources", "limitations"
        )) > 0, "extra_keys"),
        (stray(entries, ("label", "summary", "supporting_chunk_ids")), "extra_pattern_keys"),
        (stray(source_entries, ("chunk_id", "why_cited")), "extra_source_keys"),
        (~F.coalesce(d["answer_status"].isin(*DRAFT_STATUSES), F.lit(False)), "bad_status"),
        (d["overview"].isNull() | (F.length(d["overview"]) > 1200), "bad_overview"),
        (F.size(patterns) > 5, "too_many_patterns"),
        (F.size(sources) > 10, "too_many_sources"),
        (F.size(F.coalesce(d["limitations"], F.array().cast("array<string>"))) > MAX_LIMITATIONS,
         "too_many_limitations"),
        (F.exists(patterns, lambda p: p["label"].isNull() | (F.length(p["label"]) > 80)),
         "bad_label"),
        (F.exists(patterns, lambda p: p["summary"].isNull() | (F.length(p["summary"]) > 500)),
         "bad_summary"),
        (F.exists(patterns, lambda p: ~F.coalesce(
            F.size(p["supporting_chunk_ids"]).between(1, 5), F.lit(False))), "bad_support"),
        (F.exists(sources, lambda s: F.coalesce(s["chunk_id"], F.lit("")) == ""), "bad_source_id"),
        (F.exists(sources, lambda s: s["why_cited"].isNull() | (F.length(s["why_cited"]) > 400)),
         "bad_why"),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks])
    return F.filter(found, lambda x: x.isNotNull())


def resolve_id(cited: Column, valid: str) -> Column:
    """The id itself, else the one valid id it extends with '(...', else NULL."""
    return F.when(F.array_contains(valid, cited), cited).otherwise(let(
        F.filter(valid, lambda v: cited.startswith(F.concat(v, F.lit("(")))),
        lambda hits: F.when(F.size(hits) == 1, F.get(hits, F.lit(0))),
    ))


def validate_citations(df: DataFrame, draft: str = "draft", valid: str = "valid_ids") -> DataFrame:
    """Adds kept_patterns, kept_sources, citation_drops, answer_status,
    error_category, limitations.

    Any dropped citation makes the answer partial with a limitation; losing all of
    them is a generation failure.
    """
    df = df.withColumn("_p", F.transform(
        F.coalesce(F.col(draft)["patterns"], F.array().cast(ANSWER_DRAFT["patterns"].dataType)),
        lambda p: F.struct(
            p["label"].alias("label"), p["summary"].alias("summary"),
            F.transform(p["supporting_chunk_ids"], lambda c: resolve_id(c, valid)).alias("ids"),
        ),
    ))
    df = df.withColumn("_s", F.transform(
        F.coalesce(
            F.col(draft)["cited_sources"], F.array().cast(ANSWER_DRAFT["cited_sources"].dataType)
        ),
        lambda s: F.struct(
            resolve_id(s["chunk_id"], valid).alias("chunk_id"), s["why_cited"].alias("why_cited")
        ),
    ))
    lost = F.aggregate(
        "_p", F.lit(0),
        lambda acc, p: acc + F.size(F.filter(p["ids"], lambda i: i.isNull())),
    ) + F.size(F.filter("_s", lambda s: s["chunk_id"].isNull()))
    df = df.withColumn("citation_drops", lost)
    df = df.withColumn("kept_patterns", F.filter(
        F.transform("_p", lambda p: F.struct(
            p["label"].alias("label"), p["summary"].alias("summary"),
            F.array_distinct(F.filter(p["ids"], lambda i: i.isNotNull()))
            .alias("supporting_chunk_ids"),
        )),
        lambda p: F.size(p["supporting_chunk_ids"]) > 0,
    ))
    df = df.withColumn("kept_sources", F.filter("_s", lambda s: s["chunk_id"].isNotNull()))
    dropped = F.col("citation_drops") > 0
    cascade = dropped & (F.size("kept_patterns") == 0) & (F.size("kept_sources") == 0)
    own = F.coalesce(F.col(draft)["limitations"], F.array().cast("array<string>"))
    note = F.lit(PARTIAL_LIMITATION)
    noted = (
        F.when(F.array_contains(own, note), F.slice(own, 1, MAX_LIMITATIONS))
        .when(F.size(own) < MAX_LIMITATIONS, F.concat(own, F.array(note)))
        .otherwise(F.concat(F.slice(own, 1, MAX_LIMITATIONS - 1), F.array(note)))
    )
    return df.withColumn("answer_status", (
        F.when(cascade, "generation_failed").when(dropped, "partial")
        .otherwise(F.col(draft)["answer_status"])
    )).withColumn("error_category", F.when(
        cascade, "citation_validation_cascade_failure"
    )).withColumn("limitations", (
        F.when(cascade, F.array(F.lit(CASCADE_LIMITATION))).when(dropped, noted).otherwise(own)
    )).drop("_p", "_s")


def cited_ids(patterns: Column, sources: Column) -> Column:
    """First-occurrence order: pattern ids, then cited sources."""
    return F.array_distinct(F.concat(
        F.flatten(F.transform(patterns, lambda p: p["supporting_chunk_ids"])),
        F.transform(sources, lambda s: s["chunk_id"]),
    ))


def source_cards(validated: DataFrame, results: DataFrame) -> DataFrame:
    """Cited chunks in citation order with excerpt and the last stated reason."""
    cited = validated.filter(F.col("error_category").isNull()).select(
        "request_id", "kept_sources",
        F.posexplode(cited_ids(F.col("kept_patterns"), F.col("kept_sources"))).alias(
            "pos", "chunk_id"
        ),
    )
    cited = cited.select("request_id", "pos", "chunk_id", F.try_element_at(
        F.filter("kept_sources", lambda s: s["chunk_id"] == F.col("chunk_id")), F.lit(-1)
    )["why_cited"].alias("why_cited"))
    return with_excerpts(cited.join(results, ["request_id", "chunk_id"]))


def fallback_cards(packed: DataFrame) -> DataFrame:
    """Packed chunks in rank order; where nothing was packed, the first 10 results."""
    w = W.partitionBy("request_id")
    df = packed.withColumn("_any", F.max(F.col("packed").cast("int")).over(w))
    kept = df.filter(F.col("packed") | ((F.col("_any") == 0) & (F.col("rank") <= 10)))
    return with_excerpts(kept.drop("_any").withColumn(
        "why_cited", F.lit(None).cast("string")
    ))


def with_excerpts(df: DataFrame) -> DataFrame:
    df = df.withColumn("excerpt", excerpt("text", EXCERPT_CHARS))
    if "render_blocks" in df.columns:
        df = df.withColumn("excerpt_blocks", excerpt_blocks("render_blocks", EXCERPT_CHARS))
    return df


def dropped_citations(drafts: DataFrame, final_ids: str) -> DataFrame:
    """Ids named by the last draft that did not become sources, in draft order."""
    d = F.col("draft")
    return drafts.withColumn("dropped_chunk_ids", F.array_except(
        cited_ids(
            F.coalesce(d["patterns"], F.array().cast(ANSWER_DRAFT["patterns"].dataType)),
            F.coalesce(d["cited_sources"], F.array().cast(ANSWER_DRAFT["cited_sources"].dataType)),
        ),
        F.col(final_ids),
    ))
