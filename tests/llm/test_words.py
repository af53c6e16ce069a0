"""Spelling variants, ranked search and SentencePiece ids against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece

from paperfold.llm import pieces, ranked, variants
from tests.llm.test_operators import frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeèß") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    out = [None, "", " ", "  a  b\n\n c \t d ", "▁a b▁", "a ", "x" * 3000, "Straße ÉCOLE été × ÷ naïve", "中文 \U0001f600 é", "<s> <0x41> a\x00b"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(30, 120)):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "q", w[i] + "z"]) + w[i + 1 :]
            words.append(rng.choice([w, w, w.upper(), w.title()]))
        out.append(rng.choice([" ", "  ", "\n", ", "]).join(words))
    return out + out[-4:] + ["longwords" * 400 + " ok"] * 2 + ["longwordz" + "longwords" * 399] * 3


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


@pytest.mark.parametrize("ids", [None, "repeated"])
def test_spelling_variants(spark, texts, ids):
    ids = list(range(len(texts))) if ids is None else [None if i % 9 == 0 else i % 7 for i in range(len(texts))]
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.group(frame(spark, texts, ids), every=31).collect()}
    assert got == {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}
    assert form and max(map(len, near.values())) > 1 and any(len(w) > 3000 for w in n)


def test_roots_of_long_chains(spark, tmp_path):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3")], "word string, form string")
    got = dict(variants.roots(forms, variants.Stages(spark, "test")).collect())
    assert got == {f"w{i}": "w11" for i in range(11)} | {"x": "w11"}


def ranking(texts, ids, items, top=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in zip(ids, texts, strict=True)]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = Counter()
    for item, want in asked.items():
        scored = []
        for i, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            scored.append((-sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if t in c), (i is not None, i or 0)))
        for rank, (score, (known, i)) in enumerate(sorted(s for s in scored if s[0] < 0)[:top], 1):
            out[item, rank, i if known else None, -score] += 1
    return out


@pytest.mark.parametrize(("owners", "bundle", "docs", "few"), [(4, 128, 4096, True), (3, 2, 5, True), (1, 1, 1, True), (2, 3, 7, False)])
def test_ranked_search(spark, texts, monkeypatch, owners, bundle, docs, few):
    if not few:
        monkeypatch.setattr(ranked, "BROADCAST_TERMS", 0)
    rng = random.Random(4)
    words = [w for t in texts[10:20] for w in t.split()]
    items = [(k, " ".join(rng.choice(words) for _ in range(8))) for k in range(6)] + [(2, "naïve 中文"), (7, None), (8, "---"), (9, "unknownword"), (None, "naïve")]
    ids = [None if i == 7 else i // 2 if i % 5 else i for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, bundle string")
    got = Counter(map(tuple, ranked.search(frame(spark, texts, ids).repartition(3), table, owners=owners, bundle_items=bundle, shard_docs=docs).collect()))
    assert got == ranking(texts, ids, items)


@pytest.mark.parametrize("table", [0, 7, 10**6])
def test_pieces_equal_the_library(spark, texts, table):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())
    encoded = pieces.encode(frame(spark, texts), table_chunks=table)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.decode(encoded).collect()}
    want = [model.encode(t or "") for t in texts]
    assert got == {i: (ids, model.decode(ids)) for i, ids in enumerate(want)}


def test_models_that_cross_markers(texts):
    import pyarrow as pa

    found, at = pieces.chunks(pa.array(texts), False)
    assert found.to_pylist() == [t for t in texts if t] and at[-1] == len(found)
    assert pieces.segment(pieces.vocabulary(), False, ["a b"]) == [pieces.model(pieces.vocabulary()).encode("a b")]
    assert pieces.can_cut(pieces.vocabulary())


def test_decoding_of_odd_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())
    rows = [([0, 1, 2, 264],), ([3 + 0xC3, 3 + 0x28],), ([],), (None,)]
    got = [r["t"] for r in pieces.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1), out="t").collect()]
    assert got == [model.decode(r[0] or []) for r in rows]


def test_empty_tables(spark, texts):
    none, items = frame(spark, []), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert not variants.group(none).count() and not pieces.decode(pieces.encode(none)).count()
    assert not ranked.search(none, items).count() and not ranked.search(frame(spark, texts), items.limit(0)).count()
