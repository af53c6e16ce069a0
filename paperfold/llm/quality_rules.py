"""Quality rules from repetition coverage.

Rolling hashes find, for several n-gram lengths, the word n-grams that stand in the text
already, and the lines that do; a document is judged by the share of its characters that
lie inside them.

Words are runs of anything but space and \\t \\n \\v \\f \\r. Edge cases: a null or empty text
has no words and fails the base rule; repeated rows are judged one by one; an empty table
gives an empty table; other columns, whatever their names, are not read by ``measure`` and
pass unchanged through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperfold.llm import blocks as b
from paperfold.session import small_batches

# Published limits for the share of characters in duplicate n-grams and lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("dup_line_share", "dup_line_chars_share", *(f"dup_{n}gram_share" for n in NGRAM_LIMITS))
SCHEMA = (", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, "
          + ", ".join(f"{c} double" for c in SHARES))


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All measures and verdicts of the documents of a block."""
    start, end, words_at = b.words(data, at)
    n_words = np.diff(words_at)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]
    word_chars = b.total(chars, words_at)
    sums = b.prefix(data)
    h = b.substring(sums, start, end)
    doc = b.owner(words_at)
    out = {"n_words": n_words, "word_chars": word_chars,
           "n_symbols": b.total(SYMBOLS[data], at)}

    def found(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, where = b.ngrams(h, words_at, n)
        every, later = b.repeated(gram + doc[where].astype(b.U64) * b.BASE)
        return where, every, later

    line_start, line_end = b.edges(data != 10, at)
    first = np.searchsorted(start, line_start)  # a line counts if a word starts in it
    has_word = (first < len(start)) & (start[np.minimum(first, len(start) - 1)] < line_end) \
        if len(start) else np.zeros(len(line_start), bool)
    line_start, line_end = line_start[has_word], line_end[has_word]
    lines_at = np.searchsorted(line_start, at)
    line_doc = b.owner(lines_at)
    _, later = b.repeated(b.substring(sums, line_start, line_end) + line_doc.astype(b.U64) * b.BASE)
    out["n_dup_lines"] = b.total(later, lines_at)
    line_chars = points[line_end] - points[line_start]
    share = lambda part, whole: part / np.maximum(whole, 1)
    out["dup_line_share"] = share(out["n_dup_lines"], np.diff(lines_at))
    out["dup_line_chars_share"] = share(b.total(line_chars * later, lines_at), b.total(line_chars, lines_at))
    where, every, _ = found(3)
    out["n_repeat_words"] = b.total(b.covered(where[every], 3, len(start)), words_at)
    good = (out["dup_line_share"] <= LINE_LIMIT) & (out["dup_line_chars_share"] <= LINE_CHARS_LIMIT)
    for n, limit in NGRAM_LIMITS.items():
        where, _, later = found(n)
        inside = b.covered(where[later], n, len(start))
        out[f"dup_{n}gram_share"] = share(b.total(chars * inside, words_at), word_chars)
        good &= out[f"dup_{n}gram_share"] <= limit
    out["base_failed"] = (n_words < FEWEST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * n_words)
    out["kept"] = good & ~out["base_failed"]
    return out


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, the base counts, both verdicts and every coverage share."""
    names = (*COUNTS, "base_failed", "kept", *SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b.held("quality rules")
        for batch in batches:
            for rows, data, at in b.split(batch, "text", b.SMALL_BLOCK_BYTES):
                found = measures(data, at)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[n]) for n in names)], names=["doc_id", *names])

    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    return (docs.select(docs[ident].alias("doc_id"), docs[text].cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, {SCHEMA}").withColumnRenamed("doc_id", ident))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b.held("quality rules")
        for batch in batches:
            for rows, data, at in b.split(batch, text, b.SMALL_BLOCK_BYTES):
                yield rows.filter(pa.array(measures(data, at)["kept"]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
