"""Object keys, content addresses, run ids and keyed pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperfold.functions.text import U, WS, as_col, let

# Key layout and identifier patterns.
SHA256_PATTERN = r"\A[0-9a-f]{64}\z"
RUN_ID_PATTERN = r"\A[a-z0-9][a-z0-9-]{0,63}\z"
EXTENSION_PATTERN = r"\A[a-z0-9]+\z"
ARTIFACT_ROOT = "artifacts/mineru/"
ARTIFACT_FILES = {
    "content_list": "content_list.json",
    "markdown": "document.md",
    "manifest": "manifest.json",
}


def key_problem(c: Column | str) -> Column:
    """Why an object key is not acceptable; NULL when it is fine."""
    key = as_col(c)
    return (
        F.when(key.isNull() | (key == ""), "empty")
        .when(F.length(key) > 1024, "too_long")
        .when(key.contains(".."), "parent_segment")
        .when(key.startswith("/") | key.startswith("./"), "absolute")
        .when(key.contains("\\") | key.contains("\u0000"), "forbidden_char")
        .when(
            key.contains("//") | key.contains("/./") | key.endswith("/"),
            "empty_segment",
        )
        .when(key.rlike(f"{U}{WS}"), "whitespace")
        .when(key.contains("?") | key.contains("#"), "url_char")
    )


def valid_key(c: Column | str) -> Column:
    return key_problem(c).isNull()


def blob_key(sha256_hex: Column | str, extension: Column | str = "pdf") -> Column:
    """Content-addressed key; NULL for a malformed hash or extension."""
    sha = as_col(sha256_hex)
    ext = F.lit(extension) if isinstance(extension, str) else extension
    key = F.concat(
        F.lit("blobs/sha256/"),
        F.substring(sha, 1, 2),
        F.lit("/"),
        F.substring(sha, 3, 2),
        F.lit("/"),
        sha,
        F.lit("."),
        ext,
    )
    return F.when(sha.rlike(SHA256_PATTERN) & ext.rlike(EXTENSION_PATTERN), key)


def run_id(stem: Column | str) -> Column:
    """run-<slug>; NULL when the stem gives no valid id (empty or over 64 chars)."""
    slug = F.btrim(
        F.regexp_replace(F.lower(as_col(stem)), "[^a-z0-9]+", "-"), F.lit("-")
    )
    return let(F.concat(F.lit("run-"), slug), lambda value: F.when(
        (value != "run-") & value.rlike(RUN_ID_PATTERN), value
    ))


def artifact_key(run: Column | str, kind: Column | str, filename: Column | str) -> Column:
    """Key of one artifact of a conversion run; NULL when it would be invalid."""
    run_c, kind_c, name = as_col(run), as_col(kind), as_col(filename)
    fixed = F.coalesce(*[
        F.when(kind_c == k, F.lit(file)) for k, file in ARTIFACT_FILES.items()
    ])
    image_ok = (name != "") & ~name.contains("/") & ~name.contains("..")
    key = F.when(
        (kind_c == "image") & image_ok,
        F.concat(F.lit(ARTIFACT_ROOT), run_c, F.lit("/images/"), name),
    ).when(
        (kind_c != "image") & (F.coalesce(name, F.lit("")) == ""),
        F.concat(F.lit(ARTIFACT_ROOT), run_c, F.lit("/"), fixed),
    )
    return let(key, lambda k: F.when(run_c.rlike(RUN_ID_PATTERN) & valid_key(k), k))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(as_col(c), "/"), -1)


def stem_of(c: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*\z", "")


def hmac_sha256(secret: str, c: Column | str) -> Column:
    """HMAC-SHA256 as hex, from two nested sha2 calls with the pads as literals."""
    import hashlib

    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    message = F.encode(as_col(c), "UTF-8")
    return F.sha2(
        F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256
    )
