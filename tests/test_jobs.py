import json
import math
import random

import pytest
from pyspark.sql import functions as F

from paperfold.functions.providers import hashing_embedder
from paperfold.operators import artifacts as AR
from paperfold.operators import upsert as U
from paperfold.plans import chunking as C
from paperfold.plans import evaluation as E
from paperfold.plans import indexing as IX
from paperfold.plans import study as ST
from paperfold.sources import files as S
from paperfold.streaming import jobs as J
from paperfold.streaming import rate_limit as R
from paperfold.streaming.usage import usage_sink

SCHEMA = [
    {"key": "year", "label": "Year", "type": "integer", "operators": ["eq"], "exposed": True,
     "source": "chunk.year"},
    {"key": "topic", "label": "Topic", "type": "string", "operators": ["eq"], "exposed": True,
     "source": "chunk.topic"},
]


def write_paper(folder, name, parts):
    blocks = [{"type": "header", "text": "COMPUTER SCIENCE TRIPOS Part IA – 2024 – Paper 1"},
              {"type": "text", "text": f"{name} Topic (abc)"}]
    blocks += [{"type": "text", "text": p} for p in parts]
    (folder / f"y{name}_content_list.json").write_text(json.dumps(blocks), encoding="utf-8")


def test_files_to_index_and_back(spark, tmp_path):
    src = tmp_path / "ocr" / "deep"
    src.mkdir(parents=True)
    write_paper(src, "1", ["(a) one", "(b) two"])
    write_paper(src, "2", ["(a) three"])
    (src / "z_content_list.json").write_text("nope", encoding="utf-8")
    good, bad = S.read_content_lists(spark, str(tmp_path / "ocr"))
    assert bad.count() == 1
    chunks = C.chunk_papers(good, "cambridge", "cam")
    root = str(tmp_path / "index")
    embed = hashing_embedder(16)
    IX.index_chunks(chunks, "c", SCHEMA, embed, "m", 16, root)
    first = {r.chunk_id: r.text for r in spark.read.parquet(f"{root}/chunks").collect()}
    assert len(first) == 5
    # second batch: one paper changed, the other untouched
    write_paper(src, "2", ["(a) changed", "(b) new"])
    again, _ = S.read_content_lists(spark, str(tmp_path / "ocr"))
    for _ in range(2):
        IX.index_chunks(C.chunk_papers(again.filter("source_pdf = 'y2.pdf'"), "cambridge", "cam"),
                        "c", SCHEMA, embed, "m", 16, root)
    stored = {r.chunk_id: r.text for r in spark.read.parquet(f"{root}/chunks").collect()}
    assert stored["cam-2024-p1-q2-a"] == "changed" and len(stored) == 6
    assert stored["cam-2024-p1-q1-a"] == "one"
    vectors = spark.read.parquet(f"{root}/vectors").collect()
    assert {r.chunk_id for r in vectors} == set(stored) and {r.year for r in vectors} == {2024}
    with pytest.raises(U.CheckFailed):
        IX.index_chunks(chunks, "c", SCHEMA, embed, "m", 8, root)


def test_empty_folder_and_missing_metadata(spark, tmp_path):
    good, bad = S.read_content_lists(spark, str(tmp_path))
    assert good.count() == 0 and bad.count() == 0
    assert S.read_download_metadata(spark, str(tmp_path / "metadata.json")).count() == 0
    (tmp_path / "metadata.json").write_text('{"a.pdf":{"year":2020,"topic":"T"}}')
    row = S.read_download_metadata(spark, str(tmp_path / "metadata.json")).first()
    assert (row.filename, row.year, row.topic, row.paper) == ("a.pdf", 2020, "T", None)


def test_csv_index(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "Year,Paper,Q,Subject,Link,File\n2021,2,3,Maths,,x/y.pdf\n2020,1,1,,https://h/a.pdf,\nbad,1,1,,,\n"
    )
    plan, rejects = S.read_index_csv(spark, str(tmp_path / "i.csv"), "https://e.org/p/index.csv")
    rows = plan.collect()
    assert [r.source_url for r in rows] == ["https://h/a.pdf", "https://e.org/p/x/y.pdf"]
    assert rows[1].topic == "Maths" and rejects.first().missing == ["year"]


def test_pdfs_and_manifest_discovery(spark, tmp_path):
    for sub in ("a", "b"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "x.pdf").write_bytes(b"1")
    (tmp_path / "a" / "y.pdf").write_bytes(b"22")
    listing = S.read_pdfs(spark, str(tmp_path))
    only = spark.createDataFrame([("y.pdf",), ("q.pdf",)], "name string")
    problems = {(r.name, r.problem) for r in S.check_pdf_listing(listing, only).collect()}
    assert problems == {("x.pdf", "duplicate_name"), ("q.pdf", "not_found")}
    assert [r.name for r in S.select_pdfs(listing, only).collect()] == ["y.pdf"]
    paths = spark.createDataFrame(
        [("/o/p_content_list.json",), ("/o/p_content_list_v2.json",), ("/o/q/r_content_list.json",),
         ("/o/z/r_content_list.json",)], "path string")
    good, twice = AR.discover_manifests(paths)
    assert [r.source_pdf for r in good.collect()] == ["p.pdf"]
    assert [r.source_pdf for r in twice.collect()] == ["r.pdf"]


def test_schema_config_and_eval_sources(spark):
    fields = [{"key": "year", "label": "Y", "type": "integer", "operators": ["eq"], "source": "chunk.year"},
              {"key": "year", "label": "Y", "type": "string", "operators": ["eq"], "source": "chunk.marks"},
              {"key": "Bad", "label": "B", "type": "string", "operators": ["eq"]}]
    texts = spark.createDataFrame([("c", json.dumps({"version": 1, "fields": fields})), ("d", "{}")],
                                  "collection string, value string")
    _, problems = S.parse_collection_schemas(texts)
    assert {(r.collection, r.key, r.problem) for r in problems.collect()} == {
        ("c", "year", "duplicate_key"), ("c", "year", "source_type_mismatch"), ("c", "Bad", "bad_key"),
        ("d", None, "bad_schema")}
    configs = spark.createDataFrame(
        [("a.collection.json", '{"name":"a","display_name":" "}'), ("b.collection.json", '{"name":"x"}')],
        "file_name string, value string")
    assert [r.problem for r in S.parse_collection_configs(configs).orderBy("file_name").collect()] == [
        "blank_display_name", "name_mismatch"]
    cases = [{"id": "1", "query": "q", "expected": {"any_topics": ["t"]}},
             {"id": "2", "query": "q", "expected": {}},
             {"id": "3", "query": "q", "expected": {"any_topics": ["t"], "top_k": 0}}]
    specs = spark.createDataFrame([("s", 5, json.dumps(c)) for c in cases],
                                  "spec string, default_top_k int, value string")
    good, bad = S.eval_cases(specs)
    assert [(r.case_id, r.top_k) for r in good.collect()] == [("1", 5)]
    assert {r.reason for r in bad.collect()} == {"no_expectation", "bad_top_k"}
    dup = [{"id": "1", "variants": [{"id": "a", "query": "x"}, {"id": "a", "query": "y"}]},
           {"id": "2", "query": "plain"}]
    specs = spark.createDataFrame([("s", 5, json.dumps(c)) for c in dup],
                                  "spec string, default_top_k int, value string")
    good, bad = S.eval_cases(specs, "study")
    assert [r.variant_id for r in good.collect()] == ["2/default"]
    assert [r.reason for r in bad.collect()] == ["duplicate_variant"]


def test_manifest_checks(spark):
    ok = {"conversion_run_id": "run-a", "paper_id": "a", "source_pdf_key": "k", "mineru_version": "1",
          "created_at": "2024-01-01T00:00:00+02:00", "artifacts": [
              {"kind": "image", "key": "i", "content_type": "t", "sha256_hex": "0" * 64, "size_bytes": 1}]}

    def broken(**change):
        return json.dumps(ok | change)

    art = ok["artifacts"][0]
    rows = [("0", json.dumps(ok)), ("1", broken(created_at="2024-01-01T00:00:00")),
            ("2", broken(artifacts=[art | {"size_bytes": -1}])), ("3", broken(source_pdf_key="/k")),
            ("4", broken(artifacts=[art | {"kind": "x"}])), ("5", "[]"),
            ("6", json.dumps({k: v for k, v in ok.items() if k != "paper_id"}))]
    good, bad = AR.parse_manifests(spark.createDataFrame(rows, "path string, value string"))
    assert good.first().created_at.isoformat() == "2023-12-31T22:00:00"
    assert {r.path: r.reason for r in bad.collect()} == {
        "1": "timestamp_without_zone", "2": "negative_size", "3": "invalid_source_pdf_key",
        "4": "invalid_kind", "5": "not_json", "6": "missing_field"}
    again, _ = AR.parse_manifests(AR.manifest_json(good))
    assert again.drop("path").collect() == good.drop("path").collect()


def test_rate_limiter_matches_sequential_rule(spark, tmp_path):
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.expovariate(0.6)
        rows.append((f"{i:04d}", "search:ip", rng.choice("ab"), t))
    df = spark.createDataFrame(rows, "request_id string, policy string, identity string, t double")
    df = df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    usage_sink(R.decide(stream), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(
        availableNow=True
    ).start().awaitTermination()
    got = {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    state = {}
    for rid, _, who, at in rows:
        at = int(at * 1_000_000) / 1e6
        b = int(at // 60)
        ob, prev, curr = state.get(who, (-2, 0, 0))
        if b != ob:
            prev, curr = (curr if b == ob + 1 else 0), 0
        used = math.floor(prev * (1 - (at - b * 60) / 60)) + curr
        ok = used < 20
        state[who] = (b, prev, curr + ok)
        assert got[rid] == ok, rid
    assert 0 < sum(got.values()) < 400


@pytest.mark.parametrize("rows_a_batch", ["7", "10000"])
def test_rate_limiter_takes_event_time_order_in_any_batches(spark, tmp_path, rows_a_batch):
    rng = random.Random(4)
    rows = [(f"{i:04d}", "search:ip", "a", float(i)) for i in range(300)]
    want, bucket, prev, curr = {}, -2, 0, 0
    for rid, _, _, at in rows:
        now = int(at // 60)
        if now != bucket:
            prev, curr, bucket = (curr if now == bucket + 1 else 0), 0, now
        want[rid] = math.floor(prev * (1 - (at - now * 60) / 60)) + curr < 20
        curr += want[rid]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "request_id string, policy string, identity string, t double")
    df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        stream = spark.readStream.schema("request_id string, policy string, identity string, t double, ts timestamp").parquet(str(tmp_path / "in"))
        usage_sink(R.decide(stream), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_attempts_end_at_the_limit(spark):
    rows = [("a", False, 1), ("a", False, 2), ("a", False, 3), ("a", True, 4), ("b", False, 2), ("b", True, 1), ("c", False, 1)]
    got = {r.job_id: (r.receives, r.fate) for r in J.attempts(spark.createDataFrame(rows, "job_id string, ok boolean, seq long")).collect()}
    assert got == {"a": (3, "dead_letter"), "b": (1, "acked"), "c": (1, "retry")}


def test_upsert_keeps_names_that_look_like_numbers(spark, tmp_path):
    from paperfold.operators.upsert import bucket_of, read_table, upsert_table

    path = str(tmp_path / "table")
    for _ in range(2):
        rows = spark.createDataFrame([("007", "x", 1), ("2024-01-01", "x", 2)], "collection string, chunk_id string, v int")
        upsert_table(path, rows.withColumn("bucket", bucket_of("chunk_id")), ["collection", "bucket", "chunk_id"])
    assert sorted((r.collection, r.v) for r in read_table(spark, path, rows.schema).collect()) == [("007", 1), ("2024-01-01", 2)]


def test_continuous_ingest_converges(spark, tmp_path):
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    good = {"schema_version": "ingest_job_v1", "job_id": "1", "collection": "c",
            "paper_object_key": "s/y1.pdf", "parser": "cambridge", "university": "cam"}
    lines = [json.dumps(good), json.dumps(good), json.dumps(good | {"parser": "z"}), "{"]
    (jobs / "m.txt").write_text("\n".join(lines))
    src = tmp_path / "ocr"
    src.mkdir()
    write_paper(src, "1", ["(a) one"])
    root, dead = str(tmp_path / "index"), str(tmp_path / "dead")
    papers, _ = S.read_content_lists(spark, str(src))

    def index(batch):
        wanted = batch.select(F.element_at(F.split("paper_object_key", "/"), -1).alias("source_pdf"))
        todo = papers.join(wanted.distinct(), "source_pdf", "left_semi")
        IX.index_chunks(C.chunk_papers(todo, "cambridge", "cam"), "c", SCHEMA, hashing_embedder(8), "m", 8, root)

    for attempt in range(2):  # a lost checkpoint re-delivers everything
        raw = spark.readStream.schema("body string").text(str(jobs)).toDF("body")
        J.ingest_stream(raw, index, dead, str(tmp_path / f"ck{attempt}")).trigger(
            availableNow=True
        ).start().awaitTermination()
    assert spark.read.parquet(f"{root}/chunks").count() == 2
    assert {r.problem for r in spark.read.parquet(dead).collect()} == {"unknown_parser", "bad_json"}


def test_calibration_gap(spark):
    cases = spark.createDataFrame([("a", 1, 0.6, 5), ("b", 7, 0.1, 5), ("c", None, None, 5)],
                                  "case_id string, matched_rank int, matched_score double, top_k int")
    tops = spark.createDataFrame([("n1", 0.4), ("n2", None)], "query_id string, top_score double")
    row = E.score_gap(cases, tops).first()
    assert (row.weakest_positive_score, row.strongest_negative_score) == (0.6, 0.4)
    assert row.has_clean_gap and row.suggested_rerank_min_score == 0.5
    row = E.score_gap(cases, tops.limit(0)).first()
    assert not row.has_clean_gap and row.suggested_rerank_min_score is None
    assert E.effective_limit(cases, 5) == 10


def study_fixture(spark):
    ids = ["keep", "requery", "stale", "decline", "direct", "empty", "failed_grader", "cascade", "bad_draft"]
    requests = spark.createDataFrame(
        [(i, f"find {i}", "c", [], 5) for i in ids],
        "request_id string, query string, collection string, "
        "filters array<struct<field:string,op:string,value:string,value_type:string>>, top_k int")
    plan = {"semantic_queries": ["q"], "intent": "content_retrieval"}
    plans = spark.createDataFrame([
        (i, json.dumps(plan | {"semantic_queries": [f"q {i}"]}
                       | ({"intent": "out_of_scope"} if i == "direct" else {})), None) for i in ids],
        "request_id string, plan_json string, plan_error string")
    return ids, requests, plans


def test_study_job_routes_every_request(spark):
    ids, requests, plans = study_fixture(spark)
    hits = {f"q {i}": ["x1", "x2"] for i in ids if i != "empty"}
    hits |= {"again requery": ["x3"], "again stale": ["x1"], "again decline": ["x9"]}
    rows = [(q, r + 1, c, "question", None, "text of " + c, 1.0 - r / 10)
            for q, cs in hits.items() for r, c in enumerate(cs)]
    store = spark.createDataFrame(rows, "query string, rank int, chunk_id string, chunk_level string, "
                                        "parent_chunk_id string, text string, score double")

    def searcher(queries):
        return queries.select("query_id", "query").join(store, "query").drop("query")

    def g(ok):
        return json.dumps({"accepted_chunk_ids": ok, "critique": "off"})

    reject = ("requery", "stale", "decline")
    grades = [(i, 1, g([]) if i in reject else "oops" if i == "failed_grader" else g(["x2", "zz"])) for i in ids]
    grades += [("requery", 2, g(["x3"])), ("stale", 2, g(["x1"])), ("decline", 2, g([]))]
    grades = spark.createDataFrame(grades, "request_id string, pass int, grade_json string")
    again = spark.createDataFrame([(i, f"again {i}") for i in reject],
                                  "request_id string, reformulated_query string")

    def draft(i):
        cited = {"cascade": ["nope"], "requery": ["x3"]}.get(i, ["x2(i)", "gone"])
        return json.dumps({"answer_status": "ok", "overview": "o", "limitations": [], "cited_sources": [],
                           "patterns": [{"label": "l", "summary": "s", "supporting_chunk_ids": cited}]}
                          | ({"answer_status": "great"} if i == "bad_draft" else {}))

    drafts = spark.createDataFrame([(i, draft(i)) for i in ids], "request_id string, draft_json string")
    out = {r.request_id: r for r in ST.study(requests, plans, searcher, grades, again, drafts).collect()}
    assert set(out) == set(ids)
    assert {i: (r.answer_status, r.retrieval_status, r.outcome) for i, r in out.items()} == {
        "keep": ("partial", "ok", "ok"),
        "requery": ("ok", "ok", "ok"),
        "stale": ("insufficient_evidence", "low_relevance", "reflection_abstained"),
        "decline": ("insufficient_evidence", "low_relevance", "reflection_abstained"),
        "direct": ("no_corpus_answer", "skipped", "no_corpus_answer"),
        "empty": ("insufficient_evidence", "empty", "ok"),
        "failed_grader": ("partial", "ok", "ok"),
        "cascade": ("generation_failed", "ok", "citation_validation_cascade_failure"),
        "bad_draft": ("generation_failed", "ok", "schema_validation_failed"),
    }
    assert out["keep"].context_chunk_ids == ["x2"] and out["keep"].source_ids == ["x2"]
    assert out["failed_grader"].context_chunk_ids == ["x1", "x2"]
    assert out["requery"].context_chunk_ids == ["x3"] and out["requery"].requery_attempted
    assert out["cascade"].source_ids == ["x2"]
    assert "outside this past-paper collection" in out["direct"].overview
