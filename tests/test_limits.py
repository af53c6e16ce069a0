"""What grows no faster than the input: disk, Python memory, rows of one task."""

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from paperfold.functions.providers import hashing_embedder
from paperfold.operators import artifacts as AR
from paperfold.operators import vector_search as V
from paperfold.operators.upsert import upsert_table
from paperfold.plans import search as S
from paperfold.session import small_batches
from paperfold.streaming import ingest as I
from paperfold.streaming import rate_limit as R

KEYS = ["collection", "bucket", "chunk_id"]


def test_upsert_leaves_no_stage(spark, tmp_path):
    path, shared = str(tmp_path / "table"), spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    for rows in ([("c", "x", 1), ("c", "y", 1)], [("c", "x", 2), ("c", "y", 2)], [("c", "x", 3)]):
        df = spark.createDataFrame(rows, "collection string, chunk_id string, v int")
        upsert_table(path, df.withColumn("bucket", F.lit(0)), KEYS)
        assert set(os.listdir(shared)) == before
    assert {r.chunk_id: r.v for r in spark.read.parquet(path).collect()} == {"x": 3, "y": 2}


def test_texts_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        small_batches(spark, 1 << 20)

        @F.arrow_udf("long")
        def held(texts: pa.Array) -> pa.Array:
            return pa.array([texts.nbytes] * len(texts), pa.int64())

        texts = spark.range(2000).coalesce(1).select(F.repeat(F.lit("abc "), 1000).alias("text"))
        assert texts.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 2 << 20
        spark.conf.set(key, "100k")
        small_batches(spark, 1 << 20)
        assert spark.conf.get(key) == "100k"
    finally:
        spark.conf.set(key, before)


def test_embedder_takes_empty_and_missing_texts(spark):
    rows = spark.createDataFrame([(0, "A b b"), (1, ""), (2, None)], "k int, text string")
    got = {r.k: list(r.v) for r in rows.select("k", hashing_embedder(8)("text").alias("v")).collect()}
    assert sum(got[0]) == 3 and got[1] == got[2] == [0.0] * 8


def test_scores_are_held_in_slabs(monkeypatch):
    rng, sizes, plain = np.random.default_rng(1), [], np.round
    monkeypatch.setattr(V.np, "round", lambda x, d: sizes.append(x.size) or plain(x, d))
    queries, stored = rng.normal(size=(700, 8)), rng.normal(size=(4000, 8))
    asked = pd.DataFrame({"query_id": [f"q{i}" for i in range(700)], "k": 3, "collection": "c", "filters": "[]", "vector": list(queries)})
    batch = pd.DataFrame({"collection": "c", "chunk_id": [f"{i:04d}" for i in range(4000)], "embedding": list(stored)})
    got = {q: list(ids) for q, ids, _ in V.QuerySet(asked).score(batch)}
    assert max(sizes) <= 1 << 20 and sum(sizes) == 700 * 4000
    want = np.argsort(-(V.normalise(queries) @ V.normalise(stored).T), axis=1)[:, :3]
    assert got == {i: [f"{j:04d}" for j in row] for i, row in enumerate(want)}


def test_lookup_of_collections_is_broadcast(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([("c", "p", None, "question", "t"), ("c", "s", "p", "sub_question", "u")],
                                       "collection string, chunk_id string, parent_chunk_id string, chunk_level string, text string")
        keys = spark.createDataFrame([("c", "s"), ("c", "p"), ("c", "none"), ("c", None), ("d", "s")], "collection string, chunk_id string")
        found = S.chunk_lookup(keys, chunks, spark.createDataFrame([("c",)], "name string"))
        got = {(r.collection, r.chunk_id): (r.status, r.parent_text) for r in found.collect()}
        assert got == {("c", "s"): ("ok", "t"), ("c", "p"): ("ok", None), ("c", "none"): ("chunk_not_found", None),
                       ("c", None): ("chunk_not_found", None), ("d", "s"): ("collection_not_found", None)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(collection, parent_chunk_id, _slot" in "".join(c for c in plan if c != "#" and not c.isdigit())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_rate_limiter_folds_rows_without_frames():
    class Counter:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    fold = R.SlidingWindow()
    fold.counter = Counter()
    rows = [R.Row(request_id=i, epoch=e) for i, e in (("b", 5.0), ("a", 5.0), ("z", None), ("c", 1.0), ("d", 2.0))]
    got = [(r.request_id, r.allowed, r.remaining) for r in fold.handleInputRows(("study:ip", "x"), iter(rows), None)]
    assert got == [("c", True, 2), ("d", True, 1), ("a", True, 0), ("b", False, 0), ("z", False, 0)]
    assert fold.counter.kept == (0, 0, 3, 5.0)


def test_media_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def path(n):
        made.add(1)
        return f"images/{n}.png"

    media = spark.range(4).coalesce(1).select(F.lit("p.pdf").alias("source_pdf"), F.lit("c").alias("chunk_id"), F.col("id").cast("string").alias("media_id"),
                                              path("id").alias("file_path"), F.lit("").alias("object_key"))
    artifacts = spark.createDataFrame([("p.pdf", "image", f"a/{i}.png") for i in (0, 2)], "source_pdf string, kind string, key string")
    good, bad = AR.map_media(media, artifacts)
    assert sorted(r.object_key for r in good.collect()) == ["a/0.png", "a/2.png"]
    assert {(r.media_id, r.problem) for r in bad.collect()} == {("1", "missing_mapping"), ("3", "missing_mapping")}
    assert made.value == 4


def test_a_paper_of_many_jobs_is_chunked_once(spark, tmp_path):
    paper = json.dumps([{"type": "header", "text": "COMPUTER SCIENCE TRIPOS Part IA – 2024 – Paper 1"}, {"type": "text", "text": "1 Topic (abc)"}, {"type": "text", "text": "(a) one"}])
    lists = spark.createDataFrame([("s/p.pdf", paper), ("s/q.pdf", paper)], "paper_object_key string, value string")
    jobs = spark.createDataFrame([(f"c{i}", f"s/{p}.pdf", "cambridge", "cam") for i in range(3) for p in "pq"] + [("c0", "s/none.pdf", "cambridge", "cam"), ("c9", "s/p.pdf", "cambridge", None)],
                                 "collection string, paper_object_key string, parser string, university string")
    chunks, failed = I.job_chunks(jobs, lists, str(tmp_path / "chunks"))
    assert sorted((r.collection, r.id, r.source_pdf) for r in chunks.collect()) == [(f"c{i}", f"cam-2024-p1-q1{x}", "q.pdf") for i in range(3) for x in ("", "-a")]
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4
    assert [tuple(r) for r in failed.collect()] == [("c0", "s/none.pdf", "content_list_missing")]
