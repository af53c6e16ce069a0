"""Exact repeats: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Sharded suffix arrays. Every window of LENGTH bytes belongs to the shard of its anchor, the
smallest hash among its k-grams: equal windows have equal anchors, so two equal windows
always meet in one shard, wherever they stand in the corpus. Neighbouring windows with one
anchor form a segment; each window start lies in exactly one segment.

1. Segments are counted by anchor. An anchor with one segment in the corpus ends here,
   unless it stands twice in that segment (periodic text).
2. Segments with equal bytes are counted once, with their multiplicity (a passage in a third
   of all documents is one segment). Where all segments of an anchor are equal, and none
   holds it twice, no sorting is needed: every window repeats.
3. The distinct segments of the other anchors go, with their bytes, to shards. A shard sorts
   its suffixes by induced sorting and computes permuted common prefixes; a run of suffixes
   that share LENGTH bytes is a class, and its windows repeat if the class holds two window
   starts or a segment that occurs twice.
4. Repeated windows return to their documents, are united to spans and cut out.

Anchors with more than HOT_SEGMENTS distinct segments (a common line in many contexts) are
dealt out again by a second, independent anchor of each window.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows are
repeats of each other and lose everything of LENGTH bytes or more; an empty table gives an
empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages, row_key, text_of
from paperfold.llm.suffix_sort import permuted_common_prefixes, suffix_array

LENGTH = 200
ANCHOR_BYTES = 64
SHARD_BYTES = 1 << 20
HOT_SEGMENTS = 4096
SEEDS = (0, 0x5851F42D4C957F2D)


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def segments(data: np.ndarray, at: np.ndarray, length: int, k: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, first window start in it, number of starts, anchor, hash of the bytes, and
    whether the anchor stands in the segment twice, without which no window can repeat within
    it)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    sums = b.prefix(data)
    gram = b.mix((sums[k:] - sums[:-k]) * b.powers(n + 1, b.BASE_INV)[: n - k + 1] ^ b.U64(seed))
    width = length - k + 1
    least = sliding(np.minimum, gram, width)
    whole = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= length)
    whole[at[long]] += 1
    whole[at[long + 1] - length + 1] -= 1
    where = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    if not len(where):
        return empty, empty, empty, empty, empty, empty
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1] + 1) | (least[where[1:]] != least[where[:-1]])
    first = np.flatnonzero(new)
    start, count = where[first], np.diff(np.r_[first, len(where)])
    doc = np.searchsorted(at, start, "right") - 1
    h = b.substring(sums, start, start + count + length - 1)
    # A k-gram is an anchor of some window if the greatest of the minima around it is its own.
    around = np.r_[np.zeros(width - 1, b.U64), least, np.zeros(width - 1, b.U64)]
    anchors = np.flatnonzero(gram == sliding(np.maximum, around, width))
    pair = np.flatnonzero((gram[anchors[1:]] == gram[anchors[:-1]]) & (anchors[1:] - anchors[:-1] <= width))
    first, second = anchors[pair], anchors[pair + 1]
    next_pair = np.searchsorted(first, start)
    last = np.r_[second, len(data)][next_pair]
    twice = last <= start + count - 1 + width - 1
    return doc, start - at[doc], count, least[start].view(np.int64), h.view(np.int64), twice


def repeated_starts(texts: list[bytes], counts: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Of the segments of a shard, the runs of repeated window starts: (segment, from, to)."""
    sizes = np.array([len(t) for t in texts])
    at = np.r_[0, np.cumsum(sizes)]
    text = np.frombuffer(b"".join(texts), np.uint8)
    array = suffix_array(text, 256)
    shared = permuted_common_prefixes(text, array)[array]
    kind = np.cumsum(shared < length)  # the class of each suffix, in order
    segment = np.searchsorted(at, array, "right") - 1
    real = array - at[segment] < starts[segment]
    weight = np.bincount(kind[real], np.minimum(counts[segment[real]], 2), minlength=int(kind[-1]) + 1)
    found = np.zeros(len(text) + 1, np.int8)
    found[array[real & (weight[kind] >= 2)]] = 1
    inside = found[:-1].astype(bool)
    begin, end = b.edges(inside, at)
    owner = np.searchsorted(at, begin, "right") - 1
    return list(zip(owner.tolist(), (begin - at[owner]).tolist(), (end - at[owner]).tolist(), strict=True))


def segment_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """All segments of (key_id, key_text, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in b.split(batch, "text"):
                doc, start, count, anchor, h, twice = segments(data, at, length, k, SEEDS[0])
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(h), rows.column(0).take(pick), rows.column(1).take(pick),
                     pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice.astype(bool))],
                    names=["anchor", "h", "key_id", "key_text", "start", "starts", "twice"])

    return docs.mapInArrow(run, "anchor long, h long, key_id long, key_text long, start int, starts int, twice boolean")


def deal_again(slices: DataFrame, length: int, k: int) -> DataFrame:
    """Segments cut by the second anchor of their windows, which joins the shard key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.Array.from_buffers(pa.binary(), len(batch), batch.column(5).buffers(), offset=batch.column(5).offset)
            texts = data.to_pylist()
            size = np.r_[0, np.cumsum([len(t) for t in texts])]
            joined = np.frombuffer(b"".join(texts), np.uint8)
            for lo, hi in b.blocks(joined, size):
                part, at = joined[size[lo] : size[hi]], size[lo : hi + 1] - size[lo]
                doc, start, count, anchor, _, _ = segments(part, at, length, k, SEEDS[1])
                row = doc + lo
                pick = pa.array(row)
                own = batch.column(0).to_numpy(zero_copy_only=False)[row]
                cut = [texts[r][s : s + c + length - 1] for r, s, c in zip(row, start, count, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own ^ anchor), batch.column(1).take(pick), batch.column(2).take(pick),
                     batch.column(3).take(pick), pa.array(start.astype(np.int32)), pa.array(cut, pa.binary()),
                     pa.array(count.astype(np.int32))], names=batch.schema.names)

    return slices.mapInArrow(run, slices.schema)


def repeated_windows(slices: DataFrame, length: int) -> DataFrame:
    """Sorts the shards: (anchor, h, lo, hi), runs of repeated starts within a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sort() -> pa.RecordBatch:
            counts = np.array([r[3] for r in held])
            starts = np.array([r[6] for r in held])
            found = repeated_starts([r[5] for r in held], counts, starts, length)
            cols = list(zip(*((held[i][1], held[i][2], held[i][4] + lo, held[i][4] + hi) for i, lo, hi in found), strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["anchor", "h", "lo", "hi"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield sort()

    return slices.mapInArrow(run, "anchor long, h long, lo int, hi int")


def cut_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH,
                k: int = ANCHOR_BYTES) -> DataFrame:
    """Per row: id, n_bytes, kept (the remaining bytes) and spans (the removed ones)."""
    spark = docs.sparkSession
    stages = Stages(spark, "repeats")
    source = docs.select(docs[ident].alias("doc_id"), text_of(docs[text].cast("string")).alias("text"))
    source = source.select("doc_id", *row_key(), "text")
    keyed = source.select("key_id", "key_text", "text")
    every = segment_rows(keyed, length, k)
    anchors = stages.put("anchors", every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("least"), F.max("h").alias("most"), F.max("twice").alias("twice")
    ).where("n > 1 OR twice").select("anchor", ((F.col("least") != F.col("most")) | F.col("twice")).alias("mixed")))
    shared = stages.put("shared", every.drop("twice").join(anchors, "anchor"))

    distinct = shared.where("mixed").groupBy("anchor", "h").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key_id", "key_text", "start", "starts")).alias("at"))
    distinct = stages.put("distinct", distinct.select("anchor", "h", "copies", "at.*"))
    hot = stages.put("hot", distinct.groupBy("anchor").count().where(F.col("count") > HOT_SEGMENTS).select("anchor"))
    wanted = distinct.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("anchor", "h", "copies", "start", "starts")).alias("wanted"))
    piece = lambda x: F.struct(
        x["anchor"].alias("shard"), x["anchor"].alias("anchor"), x["h"].alias("h"), x["copies"].alias("copies"),
        F.lit(0).alias("offset"), F.substring(F.encode("text", "UTF-8"), x["start"] + 1, x["starts"] + (length - 1)).alias("bytes"),
        x["starts"].alias("starts"))
    slices = (keyed.join(wanted, ["key_id", "key_text"]).select(F.explode(F.transform("wanted", piece)).alias("s")).select("s.*"))
    slices = stages.put("slices", slices)
    slices = slices.join(hot, "anchor", "left_anti").unionByName(deal_again(slices.join(hot, "anchor", "left_semi").select(slices.columns), length, k)) \
        if not hot.isEmpty() else slices
    names = ["shard", "anchor", "h", "copies", "offset", "bytes", "starts"]
    windows = stages.put("windows", repeated_windows(
        slices.select(names).repartition("shard").sortWithinPartitions("shard", "h"), length))
    stages.drop("slices", "distinct", "hot", "anchors")

    spans = shared.where(~F.col("mixed")).select("key_id", "key_text", F.col("start").alias("lo"), (F.col("start") + F.col("starts")).alias("hi"))
    spans = spans.unionByName(shared.where("mixed").join(windows, ["anchor", "h"]).select(
        "key_id", "key_text", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))
    spans = spans.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    kind = docs.schema[ident].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for value, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = value.encode()
                merged: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"] + length - 1) for r in runs or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                ends = [0, *(x for m in merged for x in m), len(body)]
                kept.append(b"".join(body[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
                removed.append([{"start": lo, "end": hi} for lo, hi in merged])
                sizes.append(len(body))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)],
                                             names=["doc_id", "n_bytes", "kept", "spans"])

    out = source.join(spans, ["key_id", "key_text"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>").withColumnRenamed("doc_id", ident)
