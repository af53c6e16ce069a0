"""Metadata filters: validation, compilation, parsing of saved and URL filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.metadata import typed_value
from paperfold.functions.text import as_col
from paperfold.schemas import (
    FILTER_OPERATORS,
    MAX_QUERY_CHARS,
    MAX_SEARCH_LIMIT,
    MAX_STUDY_TOP_K,
    RERANK_CAP,
)

# Structural fields bypass the metadata document and allow equality only.
STRUCTURAL = {
    "source_pdf": {"type": "string", "operators": ["eq"]},
    "chunk_level": {"type": "string", "operators": ["eq"]},
}
KEY_PATTERN = r"\A[a-z][a-z0-9_]*\z"


class InvalidFilter(ValueError):
    pass


def value_type(value: object) -> str:
    """Strict scalar type: a bool is not an int."""
    if type(value) is bool:
        return "boolean"
    if type(value) is int:
        return "integer"
    return "string"


def conditions_from_mapping(filters: Mapping | None) -> list[dict]:
    """Mapping sugar -> conditions; marks_min, question and None handled."""
    renames = {"marks_min": ("marks", "gte"), "question": ("question_number", "eq")}
    out = []
    for key, value in (filters or {}).items():
        if value is None:
            continue
        field, op = renames.get(key, (key, "eq"))
        out.append({"field": field, "op": op, "value": value})
    return out


def check_filters(filters: Iterable[dict], schema: list[dict]) -> list[dict]:
    """One query's conditions against its collection schema (configuration-sized)."""
    declared = {f["key"]: f for f in schema} | STRUCTURAL
    checked = list(filters or [])
    for item in checked:
        field = declared.get(item["field"])
        if field is None:
            raise InvalidFilter(f"unknown_field: {item['field']}")
        if item["op"] not in field["operators"]:
            raise InvalidFilter(f"operator_not_allowed: {item['field']} {item['op']}")
        if value_type(item["value"]) != field["type"]:
            raise InvalidFilter(f"wrong_value_type: {item['field']}")
    return checked


def filter_column(
    filters: Iterable[dict], metadata: str = "metadata", promoted: Iterable[str] = ()
) -> Column:
    """Conditions AND-ed into one Column. Fields in ``promoted`` are real, typed
    columns of the table, so their predicate reaches the parquet scan."""
    parts = []
    for item in filters:
        value = item["value"]
        if item["field"] in STRUCTURAL or item["field"] in promoted:
            left = F.col(item["field"])
        else:
            left = typed_value(metadata, item["field"], value_type(value))
        parts.append({
            "eq": lambda a, b: a == b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b,
        }[item["op"]](left, F.lit(value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_chunks(chunks: DataFrame, **criteria) -> DataFrame:
    """AND of the optional year/paper/question_number/source_pdf/id/chunk_level."""
    for column, value in criteria.items():
        if value is not None:
            chunks = chunks.filter(F.col(column) == value)
    return chunks


def filter_violations(queries: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Per query condition that is not allowed: query_id, field, reason.

    queries: query_id, collection, filters array<FILTER>.
    schema_fields: collection, key, type, operators (one row per declared field).
    """
    structural = F.create_map(*[
        x for key in STRUCTURAL for x in (F.lit(key), F.array(F.lit("eq")))
    ])
    items = queries.select("query_id", "collection", F.explode("filters").alias("f"))
    joined = items.join(
        schema_fields.select(
            F.col("collection"), F.col("key").alias("_key"), F.col("type").alias("_type"),
            F.col("operators").alias("_ops"),
        ),
        (items["collection"] == schema_fields["collection"])
        & (F.col("f.field") == F.col("_key")),
        "left",
    ).drop(schema_fields["collection"])
    is_structural = F.col("f.field").isin(*STRUCTURAL)
    ops = F.when(is_structural, structural[F.col("f.field")]).otherwise(F.col("_ops"))
    kind = F.when(is_structural, "string").otherwise(F.col("_type"))
    reason = (
        F.when(ops.isNull(), "unknown_field")
        .when(~F.array_contains(ops, F.col("f.op")), "operator_not_allowed")
        .when(F.col("f.value_type") != kind, "wrong_value_type")
    )
    return joined.select(
        "query_id", F.col("f.field").alias("field"), reason.alias("reason")
    ).filter(F.col("reason").isNotNull())


def whole_number(text: Column) -> Column:
    """An integer of any length in its plain form: no sign +, underscores or leading zeros."""
    bare = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    digits = F.regexp_extract(bare, r"^[+-]?0*([0-9]*)$", 1)
    return F.when(digits == "", "0").otherwise(F.concat(F.when(bare.startswith("-"), "-").otherwise(""), digits))


def parse_filter_strings(df: DataFrame, column: str) -> DataFrame:
    """field:op:value text -> field, op, value, value_type, error (NULL when fine)."""
    raw = F.col(column)
    parts = F.split(raw, ":", 3)
    df = df.withColumn("_p", parts)
    field, op = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    text = F.get("_p", F.lit(2))
    lowered = F.lower(text)
    is_int = text.rlike(r"\A\s*[+-]?\d+(_\d+)*\s*\z")
    kind = (
        F.when(lowered.isin("true", "false"), "boolean")
        .when(is_int, "integer")
        .otherwise("string")
    )
    canonical = (
        F.when(lowered.isin("true", "false"), lowered)
        .when(is_int, whole_number(text))
        .otherwise(text)
    )
    error = (
        F.when(F.size("_p") != 3, "malformed")
        .when(~field.rlike(KEY_PATTERN), "bad_field")
        .when(~op.isin(*FILTER_OPERATORS), "unknown_operator")
        .when(op.isin("gte", "lte") & (kind != "integer"), "integer_required")
        .when(text == "", "empty_value")
    )
    good = error.isNull()
    return df.select(
        *[c for c in df.columns if c != "_p"],
        F.when(good, field).alias("field"),
        F.when(good, op).alias("op"),
        F.when(good, canonical).alias("value"),
        F.when(good, kind).alias("value_type"),
        error.alias("error"),
    )


def url_filter_params(url: Column | str) -> Column:
    """Values of all 'filter' parameters of a URL, decoded once."""
    query = F.regexp_extract(as_col(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"\Afilter="))
    return F.transform(pairs, lambda p: F.try_url_decode(F.substr(p, F.lit(8))))


def parse_url_filters(df: DataFrame, column: str, schema: list[dict] | None) -> DataFrame:
    """Access-log rows -> conditions, or the reason of the first parameter that fails.

    Adds: conditions array<struct<field,op,value>>, reason, bad_raw.
    """
    types = {f["key"]: f["type"] for f in schema or []}
    type_map = (
        F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
        if types else F.expr("cast(map() as map<string,string>)")
    )
    df = df.withColumn("_raw", url_filter_params(column))
    df = df.withColumn("_f", F.transform("_raw", lambda raw: F.struct(
        raw.alias("raw"),
        (F.size(F.split(raw, ":", 3)) == 3).alias("three"),
        F.get(F.split(raw, ":", 3), F.lit(0)).alias("field"),
        F.get(F.split(raw, ":", 3), F.lit(1)).alias("op"),
        F.get(F.split(raw, ":", 3), F.lit(2)).alias("enc"),
    )))
    df = df.withColumn("_f", F.transform("_f", lambda x: F.struct(
        x.alias("x"),
        F.try_url_decode(F.replace(x["enc"], F.lit("+"), F.lit("%2B"))).alias("value"),
        type_map[x["field"]].alias("type"),
    )))

    def reason(y: Column) -> Column:
        x = y["x"]
        kind = F.coalesce(y["type"], F.lit("string"))
        return (
            F.when(x["raw"].isNull() | ~x["three"] | (x["field"] == "") | (x["op"] == ""),
                   "malformed")
            .when(x["enc"] == "", "empty_value")
            .when(~x["op"].isin(*FILTER_OPERATORS), "unknown_operator")
            .when(y["value"].isNull(), "malformed")
            .when(y["value"] == "", "empty_value")
            .when(y["type"].isNull() & F.lit(schema is not None), "unknown_field")
            .when((kind == "integer") & ~y["value"].rlike(r"\A-?\d+\z"), "invalid_value_type")
            .when((kind == "boolean") & ~y["value"].isin("true", "false"), "invalid_value_type")
        )

    df = df.withColumn("_r", F.transform("_f", lambda y: F.struct(
        reason(y).alias("reason"), y["x"]["raw"].alias("raw"),
        F.struct(
            y["x"]["field"].alias("field"), y["x"]["op"].alias("op"), y["value"].alias("value")
        ).alias("c"),
    )))
    failed = F.get(F.filter("_r", lambda r: r["reason"].isNotNull()), F.lit(0))
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(failed.isNull(), F.transform("_r", lambda r: r["c"])).alias("conditions"),
        failed["reason"].alias("reason"),
        failed["raw"].alias("bad_raw"),
    )


def request_reject_reason(query: Column, limit: Column, rerank: Column,
                          study: Column | None = None) -> Column:
    """Why a request exceeds the declared limits; NULL when it does not."""
    reason = (
        F.when(F.length(query) > MAX_QUERY_CHARS, "query_too_long")
        .when(limit <= 0, "limit_not_positive")
    )
    if study is not None:
        reason = reason.when(study & (limit > MAX_STUDY_TOP_K), "top_k_too_large")
    return reason.when(limit > MAX_SEARCH_LIMIT, "limit_too_large").when(
        rerank & (limit > RERANK_CAP), "rerank_limit_too_large"
    )


def select_years(df: DataFrame, years: str | None, column: str = "year") -> DataFrame:
    """Rows whose year is in a '2022-2025,2019' list; a reversed range is an error."""
    if not years:
        return df
    ranges = []
    for token in filter(None, (t.strip() for t in years.split(","))):
        lo, _, hi = token.partition("-")
        lo, hi = int(lo), int(hi or lo)
        if hi < lo:
            raise ValueError(f"Invalid year range: {token}")
        ranges.append(F.col(column).between(lo, hi))
    return df.filter(reduce(lambda a, b: a | b, ranges)) if ranges else df.filter("false")
