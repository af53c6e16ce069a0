"""Index runs: published whole or not at all."""

import pytest

from paperfold.catalog import published as queries
from paperfold.catalog.published import SCHEMA
from paperfold.functions.providers import hashing_embedder
from paperfold.operators.upsert import CheckFailed
from paperfold.plans import published as P

ROW = ("collection string, id string, chunk_level string, parent_chunk_id string, sub_question_label string, text string, "
       "source_pdf string, year int, topic string, render_blocks array<struct<media_id:string>>, media array<struct<media_id:string>>")


def rows(spark, *given):
    return spark.createDataFrame([(c, i, "question", None, None, t, f"{i[0]}.pdf", 2020, "T", [], []) for c, i, t in given], ROW)


def state(store):
    return {t: sorted(map(tuple, (r.asDict().values() for r in store.table(t).drop("embedding", "render_blocks", "media").collect()))) for t in P.KEYS}


def texts(store, *names):
    return {(r.collection, r.chunk_id): r.text for r in store.table("chunks", list(names) or None).collect()}


def settings(rows, community, display, dimension=4):
    return queries.settings(rows, community, display, dimension)


@pytest.fixture
def store(spark, tmp_path):
    store = P.Published(spark, str(tmp_path / "runs"), buckets=2)
    assert store.table("chunks") is None
    first = rows(spark, ("007", "a1", "one"), ("007", "b1", "two"), ("odd name/=%", "a1", "three"))
    assert P.index_run(store, first, settings(first, None, "first"), SCHEMA, hashing_embedder(4)) == 1
    return store


def test_upsert_and_pruned_reads(spark, store):
    again = rows(spark, ("007", "b1", "changed"), ("007", "b2", "new"))
    for n in (2, 3):
        assert P.index_run(store, again, settings(again, "c1", "second"), SCHEMA, hashing_embedder(4)) == n
    assert texts(store) == {("007", "a1"): "one", ("007", "b1"): "changed", ("007", "b2"): "new", ("odd name/=%", "a1"): "three"}
    assert texts(store, "odd name/=%") == {("odd name/=%", "a1"): "three"}
    assert {(r.collection, r.community_id, r.display_name) for r in store.table("collections").collect()} == {("007", "c1", "second"), ("odd name/=%", None, "first")}
    assert sorted((r.collection, r.source_pdf) for r in store.table("papers").collect()) == [("007", "a.pdf"), ("007", "b.pdf"), ("odd name/=%", "a.pdf")]
    assert {(r.collection, r.chunk_id) for r in store.table("vectors").collect()} == set(texts(store))
    # a community may be set once; leaving it out later keeps it
    assert P.index_run(store, again, settings(again, None, "third"), SCHEMA, hashing_embedder(4)) == 4
    assert {r.community_id for r in store.table("collections", ["007"]).collect()} == {"c1"}


def test_refused_runs_change_nothing(spark, store):
    moved = rows(spark, ("007", "a1", "x"))
    P.index_run(store, moved, settings(moved, "c1", "d"), SCHEMA, hashing_embedder(4))
    before, data = state(store), store._names(f"{store.root}/data")
    for change in ("dimension", "community", "unknown", "twice", "vector"):
        given = {"dimension": settings(moved, "c1", "d", 8), "community": settings(moved, "c2", "d")}.get(change, settings(moved, "c1", "d"))
        chunks = {"unknown": rows(spark, ("nowhere", "a1", "x")), "twice": moved.unionAll(moved)}.get(change, moved)
        with pytest.raises(CheckFailed):
            P.index_run(store, chunks, given, SCHEMA, hashing_embedder({"dimension": 8, "vector": 5}.get(change, 4)))
    assert state(store) == before and store.runs() == [1, 2]
    assert sorted(store._names(f"{store.root}/data")) == sorted(data) and not [n for n in store._names(store.root) if n.startswith(".staging")]


def test_a_failure_between_tables_leaves_the_old_run(spark, store, monkeypatch):
    before, write = state(store), P.write_parts

    def broken(store, job, table, rows):
        if table == "vectors":
            raise OSError("disk")
        return write(store, job, table, rows)

    monkeypatch.setattr(P, "write_parts", broken)
    more = rows(spark, ("007", "a1", "never"), ("new", "z1", "never"))
    with pytest.raises(OSError):
        P.index_run(store, more, settings(more, None, "never"), SCHEMA, hashing_embedder(4))
    assert state(store) == before and store.runs() == [1]


def test_recreated_collections_leave_all_tables(spark, store):
    other = rows(spark, ("007", "z9", "fresh"))
    P.index_run(store, other, settings(other, None, "x", 8), SCHEMA, hashing_embedder(8), recreate=("007", "odd name/=%"))
    assert texts(store) == {("007", "z9"): "fresh"}
    assert [(r.collection, r.embedding_dimension) for r in store.table("collections").collect()] == [("007", 8)]
    assert [r.source_pdf for r in store.table("papers").collect()] == ["z.pdf"] and store.table("vectors").count() == 1
    assert store.table("chunks", run=1).count() == 3  # a reader of the run before still sees it
    store.expire(keep=1)
    assert store.runs() == [2] and texts(store) == {("007", "z9"): "fresh"} and len(store._names(f"{store.root}/data")) == 1
