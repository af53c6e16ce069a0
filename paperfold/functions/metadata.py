"""Metadata JSON: typed access, schema-ordered projection and summaries.

A collection schema is declared configuration (a handful of fields); it arrives
as a Python list of field dicts and turns into one generated expression, so the
per-row work stays inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperfold.functions.text import as_col, nonempty, strip

SQL_TYPES = {"integer": "int", "boolean": "boolean", "string": "string"}


def json_value(metadata: Column | str, key: str) -> Column:
    """metadata ->> key as text; NULL when missing or JSON null."""
    return F.get_json_object(as_col(metadata), f"$.{key}")


def typed_value(metadata: Column | str, key: str, kind: str) -> Column:
    """Value cast to its declared type; an uncastable value is NULL, not an error."""
    return json_value(metadata, key).try_cast(SQL_TYPES[kind])


def has_key(metadata: Column | str, key: str) -> Column:
    return F.array_contains(F.json_object_keys(as_col(metadata)), key)


def json_kind(payload: Column | str, path: str = "$") -> Column:
    """array / object / string / ... of a JSON document held as text."""
    return F.schema_of_variant(F.try_parse_json(as_col(payload)))


def project_chunk_metadata(schema: list[dict]) -> Column:
    """Chunk row -> metadata JSON: each sourced field, nulls left out."""
    values = []
    for field in schema:
        source = field.get("source")
        if not source:
            continue
        name = source.removeprefix("chunk.")
        if name.startswith("metadata."):
            value = F.col("metadata")[name.removeprefix("metadata.")]
        else:
            value = F.col(name)
        values.append(value.alias(field["key"]))
    return F.to_json(F.struct(*values))


def metadata_type_violations(schema: list[dict], dtypes: dict[str, str]) -> Column:
    """Keys whose source column is not exactly of the declared type.

    Column types are static in Spark, so this is a schema-time check for chunk
    columns and always 'string' for free metadata entries.
    """
    physical = {"integer": "int", "boolean": "boolean", "string": "string"}
    bad = []
    for field in schema:
        source = field.get("source")
        if not source:
            continue
        name = source.removeprefix("chunk.")
        actual = "string" if name.startswith("metadata.") else dtypes.get(name)
        if actual != physical[field["type"]]:
            bad.append(
                F.when(
                    (F.col("metadata")[name.removeprefix("metadata.")]
                     if name.startswith("metadata.") else F.col(name)).isNotNull()
                    if name.startswith("metadata.") or name in dtypes
                    else F.lit(True),
                    F.lit(field["key"]),
                )
            )
    return F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.expr(
        "cast(array() as array<string>)"
    )


def project_result_metadata(schema: list[dict], metadata: Column | str) -> Column:
    """Only declared keys, in schema order, only where present."""
    fields = [
        typed_value(metadata, f["key"], f["type"]).alias(f["key"]) for f in schema
    ]
    return F.to_json(F.struct(*fields))


def _labelled(schema: list[dict], metadata: Column | str) -> list[Column]:
    out = []
    for field in schema:
        if not field.get("exposed", True):
            continue
        value = json_value(metadata, field["key"])
        out.append(
            F.when(value.isNotNull(), F.concat(F.lit(f"{field['label']}: "), value))
        )
    return out


def metadata_summary(schema: list[dict], metadata: Column | str) -> Column:
    """'Label: value' pairs of exposed present fields joined by ' | '."""
    return F.concat_ws(" | ", *_labelled(schema, metadata))


def metadata_lines(schema: list[dict], metadata: Column | str) -> Column:
    return F.concat_ws("\n", *_labelled(schema, metadata))


def ui_summary(schema: list[dict] | None, metadata: Column | str,
               sub_label: Column | None = None) -> Column:
    """Values joined by ' / '; booleans Yes/No; all keys when nothing is declared."""
    meta = as_col(metadata)

    def shown(raw: Column, is_bool: Column) -> Column:
        yes_no = F.when(raw == "true", "Yes").when(raw == "false", "No")
        return nonempty(F.when(is_bool, yes_no).otherwise(raw))

    parsed = F.from_json(meta, "map<string,variant>")

    def entry(value: Column) -> Column:
        return shown(value.cast("string"), F.schema_of_variant(value) == "BOOLEAN")

    parts = []
    for field in schema or []:
        if not field.get("exposed", True):
            continue
        value = entry(parsed[field["key"]])
        source = field.get("source")
        if source:
            for alt in (source, source.removeprefix("chunk.")):
                value = F.coalesce(value, entry(parsed[alt]))
        parts.append(value)
    generic = F.transform(
        F.array_sort(F.map_keys(parsed)),
        lambda k: F.when(
            entry(parsed[k]).isNotNull(),
            F.concat(F.replace(k, F.lit("_"), F.lit(" ")), F.lit(": "), entry(parsed[k])),
        ),
    )
    generic_text = F.array_join(F.filter(generic, lambda x: x.isNotNull()), " / ")
    declared = F.concat_ws(" / ", *parts) if parts else F.lit("")
    base = F.when(declared != "", declared).otherwise(generic_text)
    if sub_label is None:
        return base
    return F.concat_ws(" / ", nonempty(base), nonempty(sub_label))


def embedding_text(text: Column | str, summary: Column | str) -> Column:
    """Stripped text and, when there is one, the metadata summary after a blank line."""
    return F.concat_ws("\n\n", nonempty(strip(text)), nonempty(summary))


def flat_to_json(columns: list[str]) -> Column:
    """Typed columns -> JSON object without nulls."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def json_to_flat(metadata: Column | str, types: dict[str, str]) -> list[Column]:
    """JSON object -> typed columns; a missing boolean reads as false."""
    out = []
    for key, kind in types.items():
        value = typed_value(metadata, key, kind)
        if kind == "boolean":
            value = F.coalesce(value, F.lit(False))
        out.append(value.alias(key))
    return out
