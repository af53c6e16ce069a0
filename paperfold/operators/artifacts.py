"""Conversion artifacts: manifests, catalogue, media mapping, integrity, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.keys import (
    SHA256_PATTERN,
    artifact_key,
    basename,
    blob_key,
    run_id,
    stem_of,
    valid_key,
)
from paperfold.schemas import ARTIFACT_KINDS, MANIFEST
from paperfold.session import materialise

MANIFEST_FIELDS = tuple(MANIFEST.names)
CONTENT_TYPES = {
    "pdf": "application/pdf", "json": "application/json", "md": "text/markdown",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
}


def artifact_problem(a: Column) -> Column:
    missing = F.lit(False)
    for name in ("kind", "key", "content_type", "sha256_hex", "size_bytes"):
        missing = missing | a[name].isNull()
    return (
        F.when(missing, "missing_artifact_field")
        .when(~a["kind"].isin(*ARTIFACT_KINDS), "invalid_kind")
        .when(~valid_key(a["key"]), "invalid_key")
        .when(~a["sha256_hex"].rlike(SHA256_PATTERN), "invalid_sha256")
        .when(a["size_bytes"] < 0, "negative_size")
    )


def parse_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, value) -> (valid manifests, rejects with reason)."""
    df = files.withColumn("m", F.from_json("value", MANIFEST))
    m = F.col("m")
    absent = F.size(F.array_except(
        F.array(*[F.lit(n) for n in MANIFEST_FIELDS]), F.json_object_keys("value")
    ))
    bad = F.get(
        F.filter(F.transform(m["artifacts"], artifact_problem), lambda p: p.isNotNull()), F.lit(0)
    )
    has_offset = m["created_at"].rlike(r"(Z|[+-]\d{2}:?\d{2})\z")
    reason = (
        F.when(m.isNull() | F.json_object_keys("value").isNull(), "not_json")
        .when(absent > 0, "missing_field")
        .when(bad.isNotNull(), bad)
        .when(~valid_key(m["source_pdf_key"]), "invalid_source_pdf_key")
        .when(~F.coalesce(has_offset, F.lit(False)), "timestamp_without_zone")
        .when(m["created_at"].try_cast("timestamp").isNull(), "invalid_timestamp")
    )
    df = df.withColumn("reason", reason)
    good = df.filter(F.col("reason").isNull()).select(
        "path", "m.*"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return good, df.filter(F.col("reason").isNotNull()).select("path", "reason")


def manifest_json(manifests: DataFrame) -> DataFrame:
    """path, value: compact JSON in field order, timestamps in UTC with offset."""
    created = F.concat(
        F.date_format(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")
    )
    body = F.to_json(F.struct(*[
        created.alias(n) if n == "created_at" else F.col(n) for n in MANIFEST_FIELDS
    ]))
    return manifests.select("path", body.alias("value"))


def discover_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-list paths -> (pdf name, manifest path) and the duplicated pdf names."""
    lists = files.filter(
        F.col("path").rlike(r"_content_list\.json\z") & ~F.col("path").endswith("_v2.json")
    ).select(
        F.concat(
            F.regexp_extract("path", r"([^/]*)_content_list\.json\z", 1), F.lit(".pdf")
        ).alias("source_pdf"),
        F.regexp_replace("path", r"_content_list\.json\z", "_artifact_manifest.json").alias(
            "manifest_path"
        ),
    )
    counted = lists.groupBy("source_pdf").agg(
        F.count(F.lit(1)).alias("n"), F.min("manifest_path").alias("manifest_path")
    )
    return (
        counted.filter("n = 1").select("source_pdf", "manifest_path"),
        counted.filter("n > 1").select("source_pdf", "n"),
    )


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    return F.coalesce(
        *[F.when(ext == e, F.lit(t)) for e, t in CONTENT_TYPES.items()],
        F.lit("application/octet-stream"),
    )


def artifact_catalogue(files: DataFrame) -> DataFrame:
    """paper_id, kind, path, content -> one artifact row each, content-addressed.

    Hash and size come from the binary column on the executors; no file passes the
    driver.
    """
    hashed = files.select(
        "paper_id", run_id("paper_id").alias("conversion_run_id"), "kind",
        content_type(F.col("path")).alias("content_type"),
        F.when(F.col("kind") == "image", basename("path")).otherwise("").alias("_name"),
        F.sha2("content", 256).alias("sha256_hex"),
        F.length("content").cast("bigint").alias("size_bytes"),
    )
    key = F.when(F.col("kind") == "source_pdf", blob_key("sha256_hex", "pdf")).otherwise(
        artifact_key("conversion_run_id", "kind", "_name")
    )
    return hashed.withColumn("key", key).drop("_name")


def build_manifests(catalogue: DataFrame, version: str, created_at: Column) -> DataFrame:
    """One manifest per paper: its source key and its artifacts in key order."""
    fields = ("kind", "key", "content_type", "sha256_hex", "size_bytes")
    order = {"content_list": 0, "markdown": 1, "image": 2}
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in order.items()])
    own = catalogue.withColumn("_r", rank)
    listed = F.array_sort(F.collect_list(F.when(
        F.col("kind") != "source_pdf",
        F.struct(F.col("_r"), F.col("key").alias("_k"), F.struct(*fields).alias("a")),
    )))
    return own.groupBy("paper_id", "conversion_run_id").agg(
        F.max(F.when(F.col("kind") == "source_pdf", F.col("key"))).alias("source_pdf_key"),
        F.transform(listed, lambda x: x["a"]).alias("artifacts"),
    ).select(
        "conversion_run_id", "paper_id", "source_pdf_key",
        F.lit(version).alias("mineru_version"), created_at.alias("created_at"), "artifacts",
    )


def explode_artifacts(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "paper_id", "conversion_run_id", F.explode("artifacts").alias("a")
    ).select("paper_id", "conversion_run_id", "a.*")


def namespace_problem(run: Column, kind: Column, key: Column) -> Column:
    """Why an artifact key does not belong to its run; NULL when it does."""
    prefix = F.concat(F.lit("artifacts/mineru/"), run, F.lit("/images/"))
    name = F.substr(key, F.length(prefix) + 1)
    return (
        F.when(~kind.isin("content_list", "markdown", "image"), "unsupported_kind")
        .when((kind == "image") & ~key.startswith(prefix), "image_outside_namespace")
        .when((kind == "image") & ((name == "") | name.contains("/")), "image_key_not_canonical")
        .when(
            (kind != "image")
            & ~key.eqNullSafe(artifact_key(run, kind, F.lit(""))),
            "key_mismatch",
        )
    )


def ownership_problems(manifests: DataFrame) -> DataFrame:
    """(source_pdf, problem, key) where a manifest does not belong to its paper."""
    stem = stem_of("source_pdf")
    head = manifests.withColumn("_stem", stem).withColumn("_run", run_id(F.col("_stem")))
    bad_head = head.select(
        "source_pdf",
        F.when(F.col("paper_id") != F.col("_stem"), "paper_id_mismatch")
        .when(~F.col("conversion_run_id").eqNullSafe(F.col("_run")), "run_id_mismatch")
        .alias("problem"),
        F.lit(None).cast("string").alias("key"),
    ).filter(F.col("problem").isNotNull())
    arts = head.select("source_pdf", "_run", F.explode("artifacts").alias("a"))
    bad_art = arts.select(
        "source_pdf", namespace_problem(F.col("_run"), F.col("a.kind"), F.col("a.key"))
        .alias("problem"), F.col("a.key").alias("key"),
    ).filter(F.col("problem").isNotNull())
    return bad_head.unionByName(bad_art)


def map_media(media: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media refs -> refs with object_key, and the violations.

    media: source_pdf, chunk_id, media_id, file_path, ... ; artifacts: source_pdf,
    kind, key. Images join on (source_pdf, basename); a ref without file has no key.
    The joined refs are written once: both results read them, so whatever made the media
    (chunking, as a rule) doesn't run twice.
    """
    images = artifacts.filter(F.col("kind") == "image").select(
        "source_pdf", basename("key").alias("_base"), F.col("key").alias("object_key")
    )
    index = images.groupBy("source_pdf", "_base").agg(
        F.count(F.lit(1)).alias("_n"), F.min("object_key").alias("object_key")
    )
    papers = artifacts.select("source_pdf", F.lit(True).alias("_known")).distinct()
    df = media.drop("object_key").withColumn("_base", basename("file_path"))
    df = df.join(index, ["source_pdf", "_base"], "left").join(papers, "source_pdf", "left")
    problem = F.when(
        F.col("file_path").isNotNull(),
        F.when(F.col("_known").isNull(), "missing_manifest")
        .when(F.col("object_key").isNull(), "missing_mapping")
        .when(F.col("_n") > 1, "duplicate_basename"),
    )
    df = materialise(df.withColumn("problem", problem), "media")
    good = df.filter(F.col("problem").isNull()).drop("_base", "_n", "_known", "problem")
    bad = df.filter(F.col("problem").isNotNull()).select(
        "source_pdf", "chunk_id", "media_id", "problem"
    )
    return good, bad


def integrity_problems(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Declared artifacts without a file, and files (key, content) whose hash or size
    differs from the manifest."""
    actual = files.select(
        "key", F.sha2("content", 256).alias("_sha"),
        F.length("content").cast("bigint").alias("_size"),
    )
    return artifacts.join(actual, "key", "left").select(
        "key",
        F.when(F.col("_sha").isNull(), "file_missing")
        .when(F.col("_sha") != F.col("sha256_hex"), "hash_mismatch")
        .when(F.col("_size") != F.col("size_bytes"), "size_mismatch").alias("problem"),
    ).filter(F.col("problem").isNotNull())


def media_map_json(refs: DataFrame) -> DataFrame:
    """chunk_id -> JSON list of its references in order (one chunk's refs only)."""
    names = [c for c in refs.columns if c not in ("chunk_id", "file_path", "source_pdf")]
    listed = F.array_sort(F.collect_list(F.struct(
        F.col("order_index").alias("_o"), F.col("media_id").alias("_m"), F.struct(*names).alias("r")
    )))
    return refs.groupBy("chunk_id").agg(
        F.to_json(F.transform(listed, lambda x: x["r"])).alias("refs")
    )


def load_media_map(entries: DataFrame, valid: Column) -> DataFrame:
    """All-or-nothing read: any invalid reference in a map file voids that file.

    entries: map_path, chunk_id, ref. Per file one boolean is aggregated, then the
    good files' rows are kept.
    """
    ok = entries.groupBy("map_path").agg(F.bool_and(valid).alias("ok")).filter("ok")
    return entries.join(ok.select("map_path"), "map_path", "left_semi")


def key_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Symmetric difference of (paper_id, key) sets: side missing or extra."""
    missing = expected.select("paper_id", "key").exceptAll(actual.select("paper_id", "key"))
    extra = actual.select("paper_id", "key").exceptAll(expected.select("paper_id", "key"))
    return missing.withColumn("side", F.lit("missing")).unionByName(
        extra.withColumn("side", F.lit("extra"))
    )


def classify_reuse(expected: DataFrame, manifests: DataFrame, pdfs: DataFrame,
                   stored: DataFrame) -> DataFrame:
    """paper_id -> reuse / upload / convert with the deciding reason, in order.

    expected: paper_id, key (artifacts on disk). manifests: paper_id (file stem),
    manifest columns as declared_paper_id, conversion_run_id, source_pdf_key,
    artifacts. pdfs: paper_id, sha256_hex. stored: key (object listing).
    """
    papers = expected.select("paper_id").distinct()
    arts = manifests.select(
        "paper_id", "conversion_run_id", "source_pdf_key", F.explode_outer("artifacts").alias("a")
    )
    run = run_id("paper_id")
    bad_ns = F.max(namespace_problem(run, F.col("a.kind"), F.col("a.key"))).alias("bad_ns")
    per = arts.groupBy("paper_id").agg(
        bad_ns,
        F.count("a.key").alias("n"),
        F.count_distinct("a.key").alias("n_distinct"),
        F.bool_or(F.col("a.kind") == "content_list").alias("has_list"),
    )
    diff = key_difference(
        expected, arts.filter(F.col("a.key").isNotNull()).select(
            "paper_id", F.col("a.key").alias("key")
        ).distinct(),
    ).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_diff"))
    wanted = arts.filter(F.col("a.key").isNotNull()).select(
        "paper_id", F.col("a.key").alias("key")
    ).unionByName(manifests.select("paper_id", F.col("source_pdf_key").alias("key"))).unionByName(
        manifests.select("paper_id", artifact_key(
            F.col("conversion_run_id"), F.lit("manifest"), F.lit("")
        ).alias("key"))
    )
    lost = wanted.join(stored.select("key").distinct(), "key", "left_anti").groupBy(
        "paper_id"
    ).agg(F.count(F.lit(1)).alias("n_lost"))
    df = papers
    for other in (
        manifests.select("paper_id", "declared_paper_id", "conversion_run_id", "source_pdf_key"),
        per, diff, lost, pdfs.select("paper_id", F.col("sha256_hex").alias("pdf_sha")),
    ):
        df = df.join(other, "paper_id", "left")
    reason = (
        F.when(F.col("declared_paper_id").isNull(), "no_manifest")
        .when(F.col("declared_paper_id") != F.col("paper_id"), "paper_id_mismatch")
        .when(~F.col("conversion_run_id").eqNullSafe(run), "run_id_mismatch")
        .when(F.col("bad_ns").isNotNull() | ~F.coalesce("has_list", F.lit(False)), "bad_namespace")
        .when((F.coalesce("n_diff", F.lit(0)) > 0) | (F.col("n") != F.col("n_distinct")),
              "artifact_set_differs")
        .when(~F.col("source_pdf_key").eqNullSafe(blob_key(F.col("pdf_sha"), "pdf")),
              "pdf_changed")
        .when(F.coalesce("n_lost", F.lit(0)) > 0, "object_missing")
    )
    df = df.withColumn("reason", reason)
    return df.select("paper_id", F.when(F.col("reason").isNull(), "reuse").when(
        F.col("reason") == "pdf_changed", "convert"
    ).otherwise("upload").alias("status"), "reason")
