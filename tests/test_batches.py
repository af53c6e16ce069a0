"""Identities, visibility timeouts and ingest batches against one-by-one brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperfold.catalog.published import SCHEMA, settings
from paperfold.catalog.streams import run_to_end
from paperfold.functions.providers import hashing_embedder
from paperfold.operators import constraints as C
from paperfold.operators.identity import upsert_identities
from paperfold.plans.published import Published
from paperfold.streaming.ingest import ingest_and_index
from paperfold.streaming.usage import usage_sink
from paperfold.streaming.visibility import flights


def one_by_one(logins, users, identities):
    users, ids, out = dict(users), dict(identities), []
    for seq, provider, subject, email, verified in sorted(logins):
        email = (email or "").strip().lower() or None
        external = provider != "stub_header"
        reason = ("identity_incomplete" if provider is None or subject is None else "email_not_verified" if external and not verified else "email_missing" if email is None else None)
        if reason:
            out.append((seq, None, "reject", reason))
            continue
        own = ids.get((provider, subject))
        who = own or email
        if (own or external) and any(p == provider and s != subject and e == who for (p, s), e in ids.items()):
            out.append((seq, None, "reject", "identity_collision"))
            continue
        out.append((seq, who, "known" if own else "link" if who in users else "create", None))
        users[who] = users.get(who, False) or bool(verified)
        ids.setdefault((provider, subject), who)
    return out, users, ids


@pytest.mark.parametrize("seed", [1, 2])
def test_identity_upsert_is_one_by_one(spark, seed):
    rng = random.Random(seed)
    logins = [(i, rng.choice(["oidc", "saml", "stub_header"]), rng.choice([None, *"abcdefgh"]), rng.choice([None, *(f" {c}@X.org" for c in "pqrstu")]), rng.random() < 0.8) for i in range(150)]
    users = {"p@x.org": False, "q@x.org": True}
    ids = {("oidc", "a"): "p@x.org", ("saml", "b"): "q@x.org", ("saml", "c"): "q@x.org"}
    got = upsert_identities(
        spark.createDataFrame(logins, "seq long, provider string, external_subject string, email string, email_verified boolean"),
        spark.createDataFrame([(e, e, v) for e, v in users.items()], "id string, email string, email_verified boolean"),
        spark.createDataFrame([(p, s, e) for (p, s), e in ids.items()], "provider string, external_subject string, user_id string"))
    want, after, links = one_by_one(logins, users, ids)
    assert sorted((r.seq, r.email, r.action, r.reason) for r in got[0].collect()) == want
    people = {r.email: (r.id, r.email_verified) for r in got[1].collect()}
    assert {e: v for e, (_, v) in people.items()} == after and people["p@x.org"][0] == "p@x.org"
    names = {i: e for e, (i, _) in people.items()}
    assert {(r.provider, r.external_subject): names[r.user_id] for r in got[2].collect()} == links


def test_visibility_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((f"j{rng.randrange(4)}", rng.randrange(40_000), i, rng.random() < 0.2) for i in range(120))
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    want, began, n, mark = [], {}, {}, max(r[1] for r in rows) - 600

    def settle(job, now):
        while job in began and began[job] + n[job] * 2700 <= now:
            at = began[job] + n[job] * 2700
            if n[job] == 3:
                want.append((job, "dead_letter", 3, at))
                del began[job]
            else:
                n[job] += 1
                want.append((job, "received", n[job], at))

    for job, at, _, ok in rows:
        settle(job, at)
        if job in began and ok:
            want.append((job, "acked", n[job], at))
            del began[job]
        elif job not in began and not ok:
            began[job], n[job] = at, 1
            want.append((job, "received", 1, at))
    for job in list(began):
        settle(job, mark)
    for parts in (1, 4):
        src, out = tmp_path / f"in{parts}", str(tmp_path / f"out{parts}")
        for i in range(parts):
            some = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
            spark.createDataFrame(some, "job_id string, s long, seq long, ok boolean").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("job_id string, s long, seq long, ok boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
        run_to_end(usage_sink(flights(stream), out, str(tmp_path / f"ckpt{parts}")))
        assert sorted((r.job_id, r.event, r.receives, r.at_us // 1_000_000) for r in spark.read.parquet(out).collect()) == sorted(want)


def message(key, **more):
    return json.dumps({"job_id": key, "collection": "007", "paper_object_key": f"source-pdfs/{key}.pdf", "parser": "cambridge", "university": "cam"} | more)


def test_replayed_ingest_changes_nothing(spark, tmp_path):
    paper = json.dumps([{"type": "header", "text": "COMPUTER SCIENCE TRIPOS Part IA – 2024 – Paper 1"}, {"type": "text", "text": "1 Topic (abc)"}, {"type": "text", "text": "(a) one"}])
    lists = spark.createDataFrame([("source-pdfs/p.pdf", paper), ("source-pdfs/bad.pdf", "nope")], "paper_object_key string, value string")
    bodies = [message("p"), message("p"), message("p", collection="other", university="uoe"), message("bad"), message("gone"), "{", message("p", parser="none")]
    spark.createDataFrame([(x,) for x in bodies], "body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Published(spark, str(tmp_path / "runs"), buckets=1)

    def run(name):
        raw = spark.readStream.schema("body string").parquet(str(tmp_path / "in"))
        run_to_end(ingest_and_index(raw, lists, lambda c: settings(c, None, "x", 4), SCHEMA, hashing_embedder(4), store, str(tmp_path / "dead"), str(tmp_path / name)))

    run("first")
    ids = sorted((r.collection, r.chunk_id, r.source_pdf) for r in store.table("chunks").collect())
    assert ids == [("007", "cam-2024-p1-q1", "p.pdf"), ("007", "cam-2024-p1-q1-a", "p.pdf"), ("other", "uoe-2024-p1-q1", "p.pdf"), ("other", "uoe-2024-p1-q1-a", "p.pdf")]
    assert sorted(r.problem for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == ["bad_json", "content_list_missing", "not_a_block_list", "unknown_parser"]
    assert store.batches() == {("ingest", 0)} and store.runs() == [1]
    run("second")  # a fresh checkpoint delivers batch 0 again
    assert store.runs() == [1] and sorted((r.collection, r.chunk_id, r.source_pdf) for r in store.table("chunks").collect()) == ids


def test_constraints(spark):
    rules = {"p": C.Rules(("id",), {"small": "n < 5"}, {"id": C.Unique(("id",)), "live": C.Unique(("name",), "live")}),
             "c": C.Rules((), {}, {"pair": C.Unique(("a", "b"))}, {"parent": C.Foreign(("a",), "p", ("id",))})}
    tables = {"p": spark.createDataFrame([(1, 3, "x", True), (1, 9, "x", False), (None, None, "x", True), (2, 1, None, True), (3, 1, None, True)], "id int, n int, name string, live boolean"),
              "c": spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (7, 1), (None, 2)], "a int, b int")}
    got = {(r.table, r.kind, r.constraint): r.violations for r in C.violations(tables, rules).collect()}
    assert got == {("p", "not_null", "id"): 1, ("p", "check", "small"): 1, ("p", "unique", "id"): 1, ("p", "unique", "live"): 1, ("c", "unique", "pair"): 1, ("c", "foreign", "parent"): 1}
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert {r.violations for r in C.violations(empty, rules).collect()} == {0}
