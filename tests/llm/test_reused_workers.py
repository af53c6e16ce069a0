"""What a reused Python worker keeps and takes while the pipeline's stages follow one another."""

import gc
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperfold.llm import near_duplicates, packing, quality_rules
from tests.llm.test_held_memory import ODD, words_of
from tests.llm.test_near_blocks import block


@pytest.fixture
def function_of(spark, monkeypatch):
    """The function that an operator gives to mapInArrow."""
    docs, found = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: found.append(f) or self)

    def of(operator):
        operator(docs)
        return found[-1]

    return of


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])


def test_words_go_when_another_operator_takes_the_worker(function_of):
    some = iter([batch_of(["a b c d e f"])])
    others = [lambda f=function_of(op): list(f(some)) for op in (quality_rules.keep_good, quality_rules.measure, near_duplicates.describe)]
    for other in (*others, lambda: near_duplicates.compare(block(np.random.default_rng(3), 6), 8)):
        encoder = weakref.ref(packing.encoder(packing.vocabulary()))
        gc.collect()
        assert packing.encoder(packing.vocabulary()) is encoder()  # between tasks of packing it stays
        other()
        gc.collect()
        assert encoder() is None


@pytest.mark.parametrize("operator", [quality_rules.keep_good, quality_rules.measure, near_duplicates.describe])
def test_a_batch_takes_small_blocks(function_of, operator):
    rng, run = random.Random(7), function_of(operator)
    stems = words_of(rng, 500)
    batch = batch_of([" ".join(rng.choices(stems, k=250)) for _ in range(1500)])
    tracemalloc.start()
    try:
        n = sum(len(out) for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n and peak < 24 << 20


@pytest.mark.parametrize("different", [1, 2, 7])
def test_words_of_one_hash_keep_their_own_ids(different, monkeypatch):
    monkeypatch.setattr(packing, "hashes", lambda keys: np.array([len(k) % different for k in keys.to_pylist()], np.uint64))
    monkeypatch.setattr(packing, "LEARNED_WORDS", 9)
    rng, plain = random.Random(different), Tokenizer.from_file(packing.vocabulary())
    encode = packing.WordEncoder(packing.vocabulary(), 300)
    stems = words_of(rng, 60)
    for _ in range(3):
        texts = [*ODD, None, *(" ".join(rng.choices(stems, k=30)) for _ in range(10))]
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert len(encode.words) <= 300
