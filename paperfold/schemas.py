"""Row types and frozen enumerations of the exam-corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

_ATOMS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def struct_of(ddl: str) -> T.StructType:
    """'name type, name type' -> StructType, without needing a live session."""
    out = T.StructType()
    for member in ddl.split(","):
        name, kind = member.split()
        out.add(name, _ATOMS[kind])
    return out


# Fixed values (must equal the corpus contract).
CHUNK_LEVELS = ("question", "sub_question")
MEDIA_KINDS = ("image", "table")
MEDIA_RELATIONS = ("direct", "inherited_shared", "visible_from_child")
METADATA_TYPES = ("string", "integer", "boolean")
FILTER_OPERATORS = ("eq", "gte", "lte")
LIST_MARKERS = ("bullet", "ordered", "plain")
ARTIFACT_KINDS = ("content_list", "markdown", "image", "manifest")
PARSERS = ("cambridge", "uoe")
JOB_SCHEMA_VERSION = "ingest_job_v1"
DRAFT_STATUSES = ("ok", "partial", "insufficient_evidence")
DECLINE_STATUSES = ("insufficient_evidence", "no_corpus_answer")
RERANK_CAP = 50
MAX_QUERY_CHARS = 2000
MAX_SEARCH_LIMIT = 50
MAX_STUDY_TOP_K = 20

CONTENT_BLOCK = struct_of(
    "type string, text string, text_level int, list_items array<string>, "
    "code_body string, table_body string, img_path string, page_idx int, "
    "bbox array<double>"
)
RUN = struct_of("type string, text string, latex string")
RENDER_BLOCK = (
    T.StructType()
    .add("type", T.StringType())
    .add("runs", T.ArrayType(RUN))
    .add("marker", T.StringType())
    .add("items", T.ArrayType(T.ArrayType(RUN)))
    .add("latex", T.StringType())
    .add("code", T.StringType())
    .add("language", T.StringType())
    .add("rows", T.ArrayType(T.ArrayType(T.StringType())))
    .add("media_id", T.StringType())
)
RENDER_BLOCKS = T.ArrayType(RENDER_BLOCK)
MEDIA_REF = struct_of(
    "media_id string, kind string, relation string, file_path string, "
    "object_key string, page_number int, bbox array<double>, owner_level string, "
    "owner_label string, order_index int, text_payload string, description string"
)
FILTER = struct_of(
    "field string, op string, value string, value_type string"
)
METADATA_FIELD = struct_of(
    "key string, label string, type string, operators array<string>, "
    "exposed boolean, source string"
)
COLLECTION_SCHEMA = T.StructType().add("version", T.IntegerType()).add(
    "fields", T.ArrayType(METADATA_FIELD)
)
ARTIFACT = struct_of(
    "kind string, key string, content_type string, sha256_hex string, size_bytes bigint"
)
MANIFEST = (
    T.StructType()
    .add("conversion_run_id", T.StringType())
    .add("paper_id", T.StringType())
    .add("source_pdf_key", T.StringType())
    .add("mineru_version", T.StringType())
    .add("created_at", T.StringType())
    .add("artifacts", T.ArrayType(ARTIFACT))
)
DOWNLOAD_META = struct_of(
    "year int, paper int, question int, topic string, author string, source_url string"
)
JOB = struct_of(
    "schema_version string, job_id string, collection string, "
    "paper_object_key string, parser string, university string, enqueued_at string"
)
PLAN_DRAFT = struct_of(
    "semantic_queries array<string>, intent string, generation_guidance string"
)
GRADE_DRAFT = struct_of("accepted_chunk_ids array<string>, critique string")
ANSWER_DRAFT = (
    T.StructType()
    .add("answer_status", T.StringType())
    .add("overview", T.StringType())
    .add(
        "patterns",
        T.ArrayType(
            struct_of(
                "label string, summary string, supporting_chunk_ids array<string>"
            )
        ),
    )
    .add(
        "cited_sources",
        T.ArrayType(struct_of("chunk_id string, why_cited string")),
    )
    .add("limitations", T.ArrayType(T.StringType()))
)

# Chunk columns a metadata field may be projected from, with their declared type.
CHUNK_SOURCE_TYPES = {
    "id": "string",
    "chunk_level": "string",
    "parent_chunk_id": "string",
    "text": "string",
    "year": "integer",
    "paper": "integer",
    "question_number": "integer",
    "topic": "string",
    "author": "string",
    "tripos_part": "string",
    "sub_question_label": "string",
    "marks": "integer",
    "total_marks": "integer",
    "has_code": "boolean",
    "has_figure": "boolean",
    "has_table": "boolean",
    "source_pdf": "string",
}
