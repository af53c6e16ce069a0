"""File sources: content lists, downloader metadata, CSV index, PDFs, configs, specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.keys import basename
from paperfold.functions.text import nonempty, strip
from paperfold.operators.filters import KEY_PATTERN
from paperfold.plans.chunking import parse_content_lists
from paperfold.schemas import (
    CHUNK_SOURCE_TYPES,
    COLLECTION_SCHEMA,
    DOWNLOAD_META,
    FILTER_OPERATORS,
    METADATA_TYPES,
)

# Header aliases of the CSV index, first non-empty one wins.
INDEX_ALIASES = {
    "year": ("year",),
    "paper": ("paper",),
    "question": ("question", "q"),
    "topic": ("topic", "subject", "section"),
    "author": ("author", "setter"),
    "direct_url": ("url", "pdf", "pdf_url", "question_pdf", "link"),
    "path": ("path", "file", "filename", "pdf_path", "relative_url"),
}
SOURCE_PATTERN = r"\Achunk\.([a-z_]+|metadata\.[a-z][a-z0-9_]*)\z"


def whole_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Recursive whole-text read: path, value. An empty folder gives no rows."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def read_content_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(papers, quarantine) of all *_content_list.json below a folder."""
    return parse_content_lists(whole_files(spark, folder, "*_content_list.json"))


def parse_download_metadata(texts: DataFrame) -> DataFrame:
    """One JSON object keyed by file name -> filename, year, paper, ... rows."""
    kind = T.MapType(T.StringType(), DOWNLOAD_META)
    return texts.select(F.explode(F.from_json("value", kind)).alias("filename", "m")).select(
        "filename", "m.*"
    )


def read_download_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Missing file -> empty (listed through a glob, so absence is not an error)."""
    folder, _, name = path.rpartition("/")
    return parse_download_metadata(whole_files(spark, folder, name))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Columns renamed to lowercase alphanumerics; the last of equal names wins."""
    last = {"".join(ch.lower() for ch in c if ch.isalnum()): c for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in last.items()])


def first_value(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    cleaned = ["".join(ch.lower() for ch in a if ch.isalnum()) for a in aliases]
    present = [strip(nonempty(c)) for c in cleaned if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def download_plan(rows: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """CSV index rows -> (plan sorted by year/paper/question, malformed rows)."""
    df = normalise_headers(rows)
    values = {k: first_value(df, a) for k, a in INDEX_ALIASES.items()}
    df = df.select(*[v.alias(k) for k, v in values.items()])
    numbers = ("year", "paper", "question")
    df = df.select(
        *[F.col(c).try_cast("int").alias(c) for c in numbers],
        *[c for c in df.columns if c not in numbers],
    )
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in numbers]),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("missing", missing)
    name = F.format_string("y%dp%dq%d.pdf", *numbers)
    target = F.coalesce(nonempty("direct_url"), nonempty("path"), name)
    url = F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target).when(
        target.startswith("/"),
        F.concat(F.regexp_extract(F.lit(base_url), r"\A([a-z]+://[^/]+)", 1), target),
    ).otherwise(F.concat(F.regexp_replace(F.lit(base_url), r"[^/]*\z", ""), target))
    plan = df.filter(F.size("missing") == 0).select(
        *numbers, "topic", "author", name.alias("filename"), url.alias("source_url")
    ).orderBy(*numbers)
    rejects = df.filter(F.size("missing") > 0).select(*numbers, "missing")
    return plan, rejects


def read_index_csv(spark: SparkSession, path: str, base_url: str) -> tuple[DataFrame, DataFrame]:
    return download_plan(spark.read.csv(path, header=True, multiLine=True, escape='"'), base_url)


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content, length of every PDF below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.pdf")
        .load(folder)
        .select("path", basename("path").alias("name"), "content", "length")
    )


def check_pdf_listing(listing: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Problems of a listing: duplicate base names, and asked-for names not found."""
    twice = listing.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "name", F.lit("duplicate_name").alias("problem")
    )
    if only is None:
        return twice
    lost = only.select("name").distinct().join(listing.select("name"), "name", "left_anti")
    return twice.unionByName(lost.withColumn("problem", F.lit("not_found")))


def select_pdfs(listing: DataFrame, only: DataFrame | None = None) -> DataFrame:
    if only is not None:
        listing = listing.join(only.select("name").distinct(), "name", "left_semi")
    return listing.orderBy("name")


def parse_collection_schemas(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collection, value JSON) -> (declared field rows, violations)."""
    parsed = texts.withColumn("s", F.from_json("value", COLLECTION_SCHEMA))
    fields = parsed.select(
        "collection", F.col("s.version").alias("version"), F.posexplode("s.fields").alias("pos", "f")
    ).select("collection", "version", "pos", "f.*").withColumn(
        "exposed", F.coalesce("exposed", F.lit(True))
    )
    source_name = F.regexp_replace("source", r"\Achunk\.", "")
    source_type = F.coalesce(*[
        F.when(source_name == k, F.lit(v)) for k, v in CHUNK_SOURCE_TYPES.items()
    ])
    is_free = F.col("source").startswith("chunk.metadata.")
    row_problem = (
        F.when(~F.coalesce(F.col("key").rlike(KEY_PATTERN), F.lit(False)), "bad_key")
        .when(F.coalesce("label", F.lit("")) == "", "bad_label")
        .when(~F.coalesce(F.col("type").isin(*METADATA_TYPES), F.lit(False)), "bad_type")
        .when(
            (F.coalesce(F.size("operators"), F.lit(0)) == 0)
            | F.exists("operators", lambda o: ~o.isin(*FILTER_OPERATORS)),
            "bad_operators",
        )
        .when(F.col("source").isNotNull() & ~F.col("source").rlike(SOURCE_PATTERN), "bad_source")
        .when(F.col("source").isNotNull() & ~is_free & source_type.isNull(), "unknown_source")
        .when(F.col("source").isNotNull() & ~is_free & (source_type != F.col("type")),
              "source_type_mismatch")
    )
    bad_rows = fields.select("collection", "key", row_problem.alias("problem"))
    twice = fields.groupBy("collection", "key").agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1"
    ).select("collection", "key", F.lit("duplicate_key").alias("problem"))
    broken = parsed.filter(
        F.col("s").isNull() | F.coalesce(F.col("s.version") < 1, F.lit(True))
        | (F.coalesce(F.size("s.fields"), F.lit(0)) == 0)
    ).select(
        "collection", F.lit(None).cast("string").alias("key"), F.lit("bad_schema").alias("problem")
    )
    problems = bad_rows.filter(F.col("problem").isNotNull()).unionByName(twice).unionByName(broken)
    return fields, problems


def parse_collection_configs(texts: DataFrame) -> DataFrame:
    """(file_name, value) -> name, display_name, community_id, problem."""
    parsed = texts.withColumn(
        "c", F.from_json("value", "name string, display_name string, community_id string")
    )
    expected = F.regexp_replace("file_name", r"\.collection\.json\z", "")
    problem = (
        F.when(F.col("c").isNull(), "not_json")
        .when(~F.col("c.name").eqNullSafe(expected), "name_mismatch")
        .when(F.col("c.display_name").isNotNull() & (strip("c.display_name") == ""),
              "blank_display_name")
    )
    return parsed.select("file_name", "c.*", problem.alias("problem"))


SPEC_CASE = T.StructType.fromJson({
    "type": "struct",
    "fields": [
        {"name": "id", "type": "string", "nullable": True, "metadata": {}},
        {"name": "query", "type": "string", "nullable": True, "metadata": {}},
        {"name": "filters", "nullable": True, "metadata": {}, "type": {
            "type": "array", "containsNull": True, "elementType": {
                "type": "struct", "fields": [
                    {"name": n, "type": "string", "nullable": True, "metadata": {}}
                    for n in ("field", "op", "value")
                ]}}},
        {"name": "expected", "nullable": True, "metadata": {}, "type": {
            "type": "struct", "fields": [
                {"name": n, "nullable": True, "metadata": {}, "type": {
                    "type": "array", "elementType": "string", "containsNull": True}}
                for n in ("any_chunk_ids", "any_topics")
            ] + [
                {"name": "top_k", "type": "integer", "nullable": True, "metadata": {}},
                {"name": "expected_answer_status", "type": "string", "nullable": True,
                 "metadata": {}},
            ]}},
        {"name": "expected_intent", "type": "string", "nullable": True, "metadata": {}},
        {"name": "variants", "nullable": True, "metadata": {}, "type": {
            "type": "array", "containsNull": True, "elementType": {
                "type": "struct", "fields": [
                    {"name": n, "type": "string", "nullable": True, "metadata": {}}
                    for n in ("id", "query")
                ]}}},
        {"name": "notes", "type": "string", "nullable": True, "metadata": {}},
    ],
})


def eval_cases(specs: DataFrame, kind: str = "search") -> tuple[DataFrame, DataFrame]:
    """Spec rows (spec, default_top_k, value = JSON case) -> (cases, rejects).

    search: needs an expectation and a positive top_k. study / planner: variants
    (one 'default' variant from the query when none are given), ids unique per case.
    """
    df = specs.withColumn("c", F.from_json("value", SPEC_CASE))
    none = F.array().cast("array<string>")
    base = df.select(
        "spec",
        F.col("c.id").alias("case_id"),
        F.col("c.query").alias("query"),
        F.coalesce("c.filters", F.array().cast("array<struct<field:string,op:string,value:string>>"))
        .alias("filters"),
        F.coalesce("c.expected.any_chunk_ids", none).alias("any_chunk_ids"),
        F.coalesce("c.expected.any_topics", none).alias("any_topics"),
        F.coalesce("c.expected.top_k", "default_top_k").alias("top_k"),
        F.col("c.expected.expected_answer_status").alias("expected_answer_status"),
        "c.expected_intent",
        F.coalesce("c.variants", F.array(F.struct(
            F.lit("default").alias("id"), F.col("c.query").alias("query")
        ))).alias("variants"),
        "c.notes",
    )
    ids = F.transform("variants", lambda v: v["id"])
    reason = F.when(F.coalesce("case_id", F.lit("")) == "", "missing_id")
    if kind == "search":
        reason = (
            reason.when(F.coalesce("query", F.lit("")) == "", "missing_query")
            .when((F.size("any_chunk_ids") == 0) & (F.size("any_topics") == 0), "no_expectation")
            .when(F.col("top_k") <= 0, "bad_top_k")
        )
    else:
        reason = reason.when(F.size("variants") == 0, "no_variants").when(
            F.exists("variants", lambda v: (F.coalesce(v["id"], F.lit("")) == "")
                     | (F.coalesce(v["query"], F.lit("")) == "")),
            "bad_variant",
        ).when(F.size(F.array_distinct(ids)) != F.size("variants"), "duplicate_variant")
    checked = base.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    if kind == "search":
        good = good.drop("variants")
    else:
        good = good.withColumn("v", F.explode("variants")).withColumn(
            "variant_id", F.concat_ws("/", "case_id", "v.id")
        ).withColumn("query", F.col("v.query")).drop("v", "variants")
    return good, checked.filter(F.col("reason").isNotNull()).select("spec", "case_id", "reason")


def write_report(metrics: DataFrame, path: str) -> None:
    """Small metrics table -> JSON lines with keys in sorted order."""
    ordered = metrics.select(*sorted(metrics.columns))
    ordered.coalesce(1).write.mode("overwrite").json(path)

