import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperfold.functions.providers import lexical_overlap
from paperfold.operators import filters as FL
from paperfold.operators import packing as P
from paperfold.operators import vector_search as V
from paperfold.plans import search as S

VEC = "collection string, chunk_id string, embedding array<float>, year int, lang string"
ASK = "query_id string, collection string, vector array<double>, k int, filters string"


def brute(vectors, vec, k, keep):
    out = []
    for coll, cid, emb, year, lang in vectors:
        if not keep(coll, year, lang):
            continue
        a, q = np.array(emb, dtype=np.float32).astype(float), np.array(vec)
        norm = math.sqrt(a @ a) * math.sqrt(q @ q)
        score = round(float(a @ q) / norm, 12) if norm else float("nan")
        out.append((-math.inf if math.isnan(score) else score, cid))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [cid for _, cid in out[:k]]


def corpus(n=300, dim=8):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        # a third of all rows are copies of one vector: ties must fall to the id
        emb = [1.0] * dim if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(dim)]
        if i % 50 == 1:
            emb = [0.0] * dim
        rows.append(("hot" if i % 4 else "cold", f"d{i}", emb,
                     None if i % 7 == 0 else 2000 + i % 20, rng.choice(["en", "fr"])))
    return rows


@pytest.mark.parametrize("max_broadcast", [4096, 0])
def test_batch_top_k_matches_brute_force(spark, monkeypatch, max_broadcast):
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 64)
    rows = corpus()
    vectors = spark.createDataFrame(rows, VEC).repartition(5)
    rng = random.Random(1)
    filters = ["[]", '[{"field":"year","op":"gte","value":2010}]',
               '[{"field":"lang","op":"eq","value":"en"},{"field":"year","op":"lte","value":2015}]']
    asked = [(f"q{i}", "hot" if i % 2 else "cold", [rng.uniform(-1, 1) for _ in range(8)],
              1 + i * 7 % 40, filters[i % 3]) for i in range(12)]
    asked.append(("ties", "hot", [1.0] * 8, 25, "[]"))
    got = {}
    for r in V.top_k_batch(vectors, spark.createDataFrame(asked, ASK), max_broadcast).collect():
        got.setdefault(r.query_id, []).append((r.vec_rank, r.chunk_id))
    checks = {
        filters[0]: lambda y, l: True,
        filters[1]: lambda y, l: y is not None and y >= 2010,
        filters[2]: lambda y, l: y is not None and y <= 2015 and l == "en",
    }
    for qid, coll, vec, k, f in asked:
        want = brute(rows, vec, k, lambda c, y, l: c == coll and checks[f](y, l))
        assert [c for _, c in sorted(got.get(qid, []))] == want, qid


def test_single_query_equals_batch_and_checks_dimension(spark):
    rows = corpus(60)
    vectors = spark.createDataFrame(rows, VEC)
    q = [0.3, -0.2, 0.5, 0.1, 0.0, 0.9, -0.4, 0.2]
    cond = FL.filter_column([{"field": "lang", "op": "eq", "value": "en"}], promoted=("lang",))
    one = [r.chunk_id for r in V.top_k_single(vectors, q, 12, cond).collect()]
    assert one == brute(rows, q, 12, lambda c, y, l: l == "en")
    with pytest.raises(Exception, match="dimension mismatch"):
        V.top_k_single(vectors, [1.0], 3).collect()
    with pytest.raises(ValueError):
        V.top_k_single(vectors, q, 0)


def test_pushed_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame(corpus(20), VEC).write.parquet(path)
    cond = FL.filter_column([{"field": "lang", "op": "eq", "value": "en"}], promoted=("lang",))
    plan = V.top_k_single(spark.read.parquet(path), [1.0] * 8, 3, cond)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text and "TakeOrderedAndProject" in text
    assert "year" not in text.split("ReadSchema")[1]


def test_search_rerank_threshold_levels_and_limit(spark):
    vectors = spark.createDataFrame(
        [("c", f"d{i}", [1.0, i / 10], 2000, "en") for i in range(10)], VEC
    )
    texts = ["alpha", "alpha beta", "beta", "gamma"]
    chunks = spark.createDataFrame(
        [("c", f"d{i}", "other" if i == 1 else "question", texts[i % 4]) for i in range(10)],
        "collection string, chunk_id string, chunk_level string, text string",
    )
    queries = spark.createDataFrame(
        [("q", "alpha beta", "c", [1.0, 0.0], [], 3, True)],
        "query_id string, query string, collection string, vector array<double>, "
        "filters array<struct<field:string,op:string,value:string,value_type:string>>, "
        "limit int, rerank boolean",
    )
    limits = spark.createDataFrame(
        [("c", 0.99, 0.4)], "name string, vector_min_score double, rerank_min_score double"
    )
    rows = S.search(queries, vectors, chunks, limits, lexical_overlap).orderBy("rank").collect()
    # 9 candidates; d1 (bad level) takes no slot; equal scores keep the vector order
    assert [(r.chunk_id, r.score) for r in rows] == [("d5", 1.0), ("d0", 0.5), ("d2", 0.5)]
    plain = S.search(queries.withColumn("rerank", F.lit(False)), vectors, chunks, limits)
    assert [r.chunk_id for r in plain.orderBy("rank").collect()] == ["d0"]


def test_nan_score_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"), 0.5), (0.4, 0.5), (0.6, 0.5), (float("nan"), None)],
                               "s double, m double")
    got = [r.ok for r in df.select(S.passes_threshold(F.col("s"), F.col("m")).alias("ok")).collect()]
    assert got == [False, False, True, True]
    with pytest.raises(Exception, match="finite"):
        df.select(S.passes_threshold(F.col("s"), F.lit(float("inf")))).collect()


def test_filter_argument_checks():
    schema = [{"key": "marks", "type": "integer", "operators": ["eq", "gte"]}]
    got = FL.conditions_from_mapping({"marks_min": 3, "question": 2, "topic": None})
    assert got == [{"field": "marks", "op": "gte", "value": 3},
                   {"field": "question_number", "op": "eq", "value": 2}]
    for bad in ({"field": "x", "op": "eq", "value": 1}, {"field": "marks", "op": "lte", "value": 1},
                {"field": "marks", "op": "eq", "value": True},
                {"field": "source_pdf", "op": "gte", "value": "a"}):
        with pytest.raises(FL.InvalidFilter):
            FL.check_filters([bad], schema)


RESULT = ("query_id string, rank int, chunk_id string, chunk_level string, parent_chunk_id string, "
          "text string, score double")


def test_dedupe_golden(spark):
    rows = [("q", 1, "s1", "sub_question", "p1", "", 0.9), ("q", 2, "p1", "question", None, "", 0.8),
            ("q", 3, "p2", "question", None, "", 0.7), ("q", 4, "s2", "sub_question", "p2", "", 0.7),
            ("q", 5, "s3", "sub_question", "zz", "", 0.1)]
    got = P.dedupe_parent_child(spark.createDataFrame(rows, RESULT)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["s1", "p2", "s3"]


def test_packing_golden_and_brute_force(spark):
    abc = [("q", i + 1, c, "question", None, "x" * 40, 1.0) for i, c in enumerate("abc")]
    rng = random.Random(5)
    many = [(f"r{q}", i + 1, f"c{i}", "question", None, "w " * rng.randint(1, 60), 0.5)
            for q in range(20) for i in range(rng.randint(1, 15))]
    packed = P.pack(spark.createDataFrame(abc + many, RESULT), 20, 15).collect()
    by = {}
    for r in packed:
        by.setdefault(r.query_id, []).append(r)
    assert [r.packed for r in sorted(by["q"], key=lambda r: r.rank)] == [True, True, False]
    for rows in by.values():
        used = 0
        for r in sorted(rows, key=lambda r: r.rank):
            tokens = max(1, len(r.packed_text) // 4)
            assert r.tokens == tokens and r.packed == (used + tokens <= 20)
            used += tokens if r.packed else 0
        assert {r.status for r in rows} == {"ok" if used else "context_pack_failed"}
