"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to OWNERS owners. One pass over the documents writes, for
each shard of documents and each owner, the postings of the owner's terms. Bundles of items
then visit the owners one after another: a stage is a cogroup of the bundles of a shard, each
with its sparse accumulators (item, document, score), with the owner's postings of the shard.
The owner adds integer contributions and hands the accumulators on; the last one emits the
best documents of each item in the shard, of which Spark keeps the best overall.

Nothing is pruned, so scores are whole. A group holds one bundle and one shard, both of
bounded size, whatever the tables hold.

Edge cases: null and empty texts have no terms, so they are counted nowhere and never
returned; items without terms, or none that a document holds, have no row; items that share
an id are one item with the terms of all; a null item id or document id is an id of its own;
repeated documents are ranked each; equal scores go by ascending id, null first; empty tables
give an empty result; other columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages, text_of

OWNERS = 4
BUNDLE_ITEMS = 128
SHARD_DOCS = 4096
SHARD_BYTES = 4 << 20
BROADCAST_TERMS = 500_000
TOP = 10
NO_ID = -(2**63)
IN_TERM = np.ones(256, bool)
IN_TERM[:128] = False
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
POSTINGS = ("shard long, owner int, terms array<string>, counts array<int>, docs binary, tfs binary, lengths binary, "
            "ids array<long>, n_docs long, n_terms long")


def terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of all texts and the n + 1 offsets of the texts among them."""
    inside = IN_TERM[data]
    start, end = b.edges(inside, at)
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    kept = b.LOWER[data[inside]]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept)), np.searchsorted(start, at)


def item_terms(items: DataFrame, ident: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in b.split(batch, "text"):
                found, term_at = terms(data, at)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(b.owner(term_at))), found.cast(pa.string())], names=["item_id", "term"])

    rows = items.select(F.coalesce(items[ident].cast("long"), F.lit(NO_ID)).alias("item_id"), text_of(items[text].cast("string")).alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def owner_of(words: list[str], owners: int) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % owners for w in words], np.int64)


def postings(docs: DataFrame, ident: str, text: str, owners: int, vocabulary, shard_docs: int, shard_bytes: int) -> DataFrame:
    """One row for each shard and owner: the owner's terms, how many documents hold each, and
    these documents (numbers in the shard) and frequencies, by term."""

    def shard(rows: pa.RecordBatch, wanted: pa.Array | None, number: int) -> pa.RecordBatch:
        data, at = b.flat(rows.column(1))
        found, term_at = terms(data, at)
        coded = found.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        doc, lengths = b.owner(term_at), np.diff(term_at)
        if wanted is not None:
            use = pc.is_valid(pc.index_in(words, wanted)).to_numpy(zero_copy_only=False)
            doc, code = doc[use[code]], code[use[code]]
        pair, tf = np.unique(code * len(rows) + doc, return_counts=True)
        code, doc = pair // max(len(rows), 1), pair % max(len(rows), 1)
        used, first = np.unique(code, return_index=True)
        names, count = words.take(pa.array(used)).to_pylist(), np.diff(np.r_[first, len(code)])
        of_term = owner_of(names, owners)
        of_posting = np.repeat(of_term, count)
        out = []
        for o in range(owners):
            mine, last = np.flatnonzero(of_term == o), o == owners - 1
            out.append((number, o, [names[i] for i in mine], count[mine].tolist(), doc[of_posting == o].astype("<i4").tobytes(), tf[of_posting == o].astype("<i4").tobytes(),
                        lengths.astype("<i8").tobytes(), rows.column(0).to_pylist() if last else [], int((lengths > 0).sum()) if last else 0, int(lengths.sum()) if last else 0))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in POSTINGS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary.value, pa.large_string()) if vocabulary is not None else None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, at = b.flat(batch.column(1))
            for first, last in b.blocks(np.arange(0), at, shard_bytes):
                for lo in range(first, last, shard_docs):
                    yield shard(batch.slice(lo, min(shard_docs, last - lo)), wanted, number)
                    number += 1

    rows = docs.select(F.coalesce(docs[ident].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs[text].cast("string")).alias("text"))
    return rows.mapInArrow(run, POSTINGS)


def contributions(post: dict, n_docs: int, n_terms: int) -> np.ndarray:
    """What the frequency and the document's length make of each posting, before its weight."""
    tf, doc = np.frombuffer(post["tfs"], "<i4").astype(np.int64), np.frombuffer(post["docs"], "<i4")
    m = 100 - 90 + (90 * np.frombuffer(post["lengths"], "<i8") * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Where the ``top`` highest positive scores are; equal ones by ascending id."""
    where = np.flatnonzero(scores > 0)
    if len(where) > top:
        where = where[scores[where] >= np.partition(scores[where], -top)[-top]]
    return where[np.lexsort((ids[where], -scores[where]))[:top]]


def search(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item_ident: str = "item_id", item_text: str = "text",
           top: int = TOP, owners: int = OWNERS, bundle_items: int = BUNDLE_ITEMS, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item."""
    spark = docs.sparkSession
    stages = Stages(spark, "ranked")
    asked = stages.put("asked", item_terms(items, item_ident, item_text))
    sizes = asked.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("term").alias("terms")).first()
    few = sizes["terms"] <= BROADCAST_TERMS
    vocabulary = spark.sparkContext.broadcast([r[0] for r in asked.select("term").distinct().collect()]) if few else None
    held = stages.put("postings", postings(docs, ident, text, owners, vocabulary, shard_docs, shard_bytes))
    n_docs, n_terms = (int(x or 0) for x in held.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    df = held.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    bundles = max(1, -(-sizes["items"] // bundle_items))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weighted = asked.join(df, "term").select("item_id", "term", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int").alias("bundle"), weight.alias("weight"),
                                             (F.crc32(F.col("term").cast("binary")) % owners).cast("int").alias("owner"))
    members = asked.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int").alias("bundle")).groupBy("bundle").agg(
        F.sort_array(F.collect_set("item_id")).alias("members"))
    plan = weighted.join(members, "bundle").groupBy("bundle", "owner").agg(
        F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.collect_list(F.array_position("members", F.col("item_id")).cast("int") - 1).alias("items"))
    plan = stages.put("plan", plan.join(members, "bundle"))

    numbers = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    carried = held.where(F.col("owner") == 0).select(F.col("shard").alias("shard"), numbers.alias("bundle"), F.lit(b"").alias("cells"), F.lit(b"").alias("scores"))

    def stage(last: bool):
        def add(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"bundle": [], "shard": [], "cells": [], "scores": []} if not last else {"item_id": [], "doc_id": [], "score": []}
            if left.num_rows and right.num_rows:
                visitor, post = left.to_pylist()[0], right.to_pylist()[0]
                docs_here, members = len(post["lengths"]) // 8, visitor["members"] or []
                acc = np.zeros(max(len(members), 1) * docs_here, np.int64)
                acc[np.frombuffer(visitor["cells"], "<i4")] = np.frombuffer(visitor["scores"], "<i8")
                acc = acc.reshape(max(len(members), 1), docs_here)
                place = {t: i for i, t in enumerate(post["terms"])}
                ends = np.r_[0, np.cumsum(post["counts"], dtype=np.int64)]
                doc, each = np.frombuffer(post["docs"], "<i4"), contributions(post, n_docs, n_terms)
                for term, w, item in zip(visitor["terms"] or [], visitor["weights"] or [], visitor["items"] or [], strict=True):
                    i = place.get(term)
                    if i is not None:
                        acc[item, doc[ends[i] : ends[i + 1]]] += w * each[ends[i] : ends[i + 1]]
                if last:
                    ids = np.array(post["ids"], np.int64)
                    for i, item in enumerate(members):
                        where = best(acc[i], ids, top)
                        out["item_id"] += [item] * len(where)
                        out["doc_id"] += ids[where].tolist()
                        out["score"] += acc[i, where].tolist()
                else:
                    cells = np.flatnonzero(acc)
                    out = {"bundle": [visitor["bundle"]], "shard": [visitor["shard"]], "cells": [cells.astype("<i4").tobytes()],
                           "scores": [acc.ravel()[cells].astype("<i8").tobytes()]}
            kinds = {"bundle": pa.int32(), "shard": pa.int64(), "cells": pa.binary(), "scores": pa.binary(), "item_id": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
            return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

        return add

    for o in range(owners):
        last = o == owners - 1
        mine = plan.where(F.col("owner") == o).select("bundle", "terms", "weights", "items")
        with_plan = carried.join(mine, "bundle", "left").join(plan.select("bundle", "members").dropDuplicates(["bundle"]), "bundle")
        right = held.where(F.col("owner") == o).select(F.col("shard").alias("in_shard"), numbers.alias("in_bundle"), "terms", "counts", "docs", "tfs", "lengths", "ids")
        moved = with_plan.groupBy("shard", "bundle").cogroup(right.groupBy("in_shard", "in_bundle")).applyInArrow(
            stage(last), "item_id long, doc_id long, score long" if last else "bundle int, shard long, cells binary, scores binary")
        carried = moved if last else stages.put(f"owner{o}", moved)
        if o > 0 and not last:
            stages.drop(f"owner{o - 1}")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return carried.select("item_id", rank.cast("int").alias("rank"), "doc_id", "score").where(F.col("rank") <= top).select(
        whole("item_id"), "rank", whole("doc_id"), "score")
