"""SentencePiece ids by a table of distinct chunks, and texts from ids.

Where no piece of a model holds a whitespace marker after another character, a text can be
cut before each run of markers: the pieces of a chunk don't depend on its neighbours. Spark
counts the distinct chunks of the corpus. The most frequent ones, up to a bound of entries and
bytes, are segmented once each and broadcast as a table, from which ids come back by position.
A chunk beyond the bound is segmented once in each block of texts that holds it: moving the
texts to such chunks, or the chunks to their texts, costs more than segmenting them anew. A
model whose pieces may cross markers makes each distinct text a chunk.

Edge cases: null and empty texts have no ids; a text of one long word is one chunk; repeated
rows give repeated rows; an empty table gives an empty result; null ids stay null and get
their own rows; columns other than id and text are not read, whatever their names. Ids that
the model doesn't have raise an error on decoding; null lists decode to an empty text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages, text_of

MARKER = "▁"
TABLE_CHUNKS = 500_000
TABLE_BYTES = 32 << 20
LONGEST_IN_TABLE = 1024
BLOCK_BYTES = 2 << 20
STEPS_PER_DOUBLING = 8
DECODED_AT_ONCE = 1 << 18


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str):
    """The model of this process: a reused Python worker loads it once."""
    from sentencepiece import SentencePieceProcessor

    held = sys.modules.setdefault("llm_piece_models", ModuleType("llm_piece_models")).__dict__
    if path not in held:
        held[path] = SentencePieceProcessor(model_file=path)
    return held[path]


def can_cut(path: str) -> bool:
    """Whether chunks are independent: no piece crosses into a marker, and the model neither
    rewrites characters nor drops white space."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model(path).serialized_model_proto())
    rules = proto.normalizer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    return plain and not proto.trainer_spec.treat_whitespace_as_suffix and not any(
        p.type == p.USER_DEFINED or MARKER in p.piece.lstrip(MARKER) for p in proto.pieces)


def chunks(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts and the n + 1 offsets of the texts among them. A chunk begins
    with its markers, written as spaces; the first has the marker that the model adds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if cut:
        texts = pc.replace_substring(texts, MARKER, " ")  # the model makes them equal
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, at = b.flat(texts)
    start = np.zeros(len(data), bool)
    if cut and len(data):
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
    start[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.r_[starts, len(data)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), np.searchsorted(starts, at)


def segment(path: str, cut: bool, words: list[str]) -> list[list[int]]:
    """The ids of each chunk. The model adds a marker itself, so one is taken off; a marker
    alone is what follows another chunk."""
    held = model(path)
    if not cut:
        return held.encode(words)
    found = held.encode([w[1:] for w in words])
    if " " in words:
        found[words.index(" ")] = held.encode("a ")[len(held.encode("a")):]
    return found


def joined_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the n + 1 offsets of the lists."""
    ends = np.r_[0, np.cumsum([len(i) for i in lists], dtype=np.int64)]
    return np.fromiter((x for i in lists for x in i), np.int32, int(ends[-1])), ends


def distinct_chunks(docs: DataFrame, cut: bool) -> DataFrame:
    """(chunk, n): the distinct chunks of all texts; blocks are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in b.split(batch, "text"):
                coded = chunks(rows.column(0), cut)[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n, pa.int64())], names=["chunk", "n"])

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(table: DataFrame, path: str, cut: bool) -> DataFrame:
    """(chunk, ids): each chunk segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = joined_ids(segment(path, cut, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["chunk", "ids"])

    return table.select("chunk").mapInArrow(run, "chunk string, ids array<int>")


def least_count_of_head(counted: DataFrame, most: int, most_bytes: int) -> int:
    """The least n such that the chunks of that many occurrences fit the bounds of the table;
    taken from sums per logarithmic class of n, of which there are a few hundred at most. A
    chunk has at most one id a byte."""
    step = F.floor(F.log2("n") * STEPS_PER_DOUBLING)
    classes = counted.where(F.octet_length("chunk") <= LONGEST_IN_TABLE).groupBy(step.alias("step")).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("chunks"), F.sum(5 * F.octet_length("chunk") + 16).alias("bytes")).collect()
    least, held, used = 1 << 62, 0, 0
    for c in sorted(classes, key=lambda c: -c["step"]):
        held, used = held + c["chunks"], used + c["bytes"]
        if held > most or used > most_bytes:
            break
        least = c["least"]
    return least


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None,
           table_chunks: int = TABLE_CHUNKS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, ids): the ids of every text, without begin or end."""
    path = path or vocabulary()
    cut = can_cut(path)
    stages = Stages(docs.sparkSession, "pieces")
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(text_of(docs[text].cast("string")).alias("text"), docs[ident].alias("id"))
    counted = stages.put("counted", distinct_chunks(rows, cut).where("n > 1"))
    frequent = counted.where((F.octet_length("chunk") <= LONGEST_IN_TABLE) & (F.col("n") >= least_count_of_head(counted, table_chunks, table_bytes)))
    table = segmented(frequent, path, cut).toArrow()  # at most table_chunks and table_bytes
    stages.drop("counted")
    lists = table["ids"].combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast((
        table["chunk"].combine_chunks().cast(pa.large_string()), lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, ends = sent.value
        for batch in batches:
            _, bounds = b.flat(batch.column(0))
            for first, last in b.blocks(np.arange(0), bounds, BLOCK_BYTES):
                part = batch.slice(first, last - first)
                found, at = chunks(part.column(0), cut)
                coded = found.dictionary_encode()
                known = pc.index_in(coded.dictionary, words)
                other = np.flatnonzero(pc.is_null(known).to_numpy(zero_copy_only=False))
                place = pc.fill_null(known, 0).to_numpy().astype(np.int64)
                place[other] = len(words) + np.arange(len(other))
                more, more_ends = joined_ids(segment(path, cut, coded.dictionary.take(pa.array(other)).to_pylist()))
                all_ids, all_ends = np.concatenate([ids, more]), np.r_[ends, ends[-1] + more_ends[1:]]
                code = place[coded.indices.to_numpy()]
                size = all_ends[code + 1] - all_ends[code]
                upto = np.cumsum(size)
                where = np.repeat((all_ends[code] - upto + size).astype(np.int32), size)
                where += np.arange(len(where), dtype=np.int32)
                out = all_ids[where]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(np.r_[0, upto][at], pa.int32()), pa.array(out))], names=["id", "ids"])

    return rows.mapInArrow(placed, f"id {kind}, ids array<int>").withColumnRenamed("id", ident)


def decode(frame: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """The frame with the text of its ids in the column ``out``."""
    path = path or vocabulary()
    frame = frame.drop(out)
    where = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(path)
        for batch in batches:
            column, texts, first = batch.column(where), [], 0
            upto = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            while first < len(column):
                before = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, before + DECODED_AT_ONCE, "right")))
                texts += held.decode([i or [] for i in column.slice(first, last - first).to_pylist()])
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{named}, `{out}` string")
