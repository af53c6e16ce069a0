"""What the Python workers of the pipeline's stages hold."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperfold.llm import near_duplicates, packing, quality_rules

ODD = ["", " ", "\n", "don't DON'T", "<|endoftext|> a<|b", "İstanbul été été", "x7y 7 77 abc7", "中文字 \U0001f600é", "a\x00b \t c", "..!? -- (a)[b]{c}~`"]


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé0123456789'-") for _ in range(rng.randrange(4, 12))) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 40, 10**6])
@pytest.mark.parametrize("pieces", [5, 8192])
def test_encoder_gives_the_tokenizers_ids(most, pieces, monkeypatch):
    monkeypatch.setattr(packing, "ENCODED_PIECES", pieces)
    rng, plain = random.Random(most + pieces), Tokenizer.from_file(packing.vocabulary())
    encode = packing.WordEncoder(packing.vocabulary(), most)
    stems = words_of(rng, 60)
    for _ in range(3):  # later blocks meet words that are known, forgotten and new
        texts = ODD + [None] + [" ".join(rng.choice(stems + words_of(rng, 5)) for _ in range(30)) for _ in range(10)]
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert len(encode.words) <= most and len(encode.parts) <= most


def test_a_remembered_word_costs_few_bytes():
    texts = pa.array([" ".join(words_of(random.Random(5), 40_000))])
    encode = packing.WordEncoder(packing.vocabulary())
    encode(pa.array(["a"]))
    tracemalloc.start()
    try:
        arrow, before = pa.total_allocated_bytes(), tracemalloc.get_traced_memory()[0]
        encode(texts)
        held = tracemalloc.get_traced_memory()[0] - before + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 150 * 40_000


def test_stages_take_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    stages = (quality_rules.keep_good, quality_rules.measure, near_duplicates.group, packing.pack)
    try:
        for stage in stages:
            spark.conf.set(key, "64m")
            stage(docs)
            assert int(spark.conf.get(key)) <= 4 << 20, stage
        spark.conf.set(key, "64m")
        texts = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat('abc ', 2500) AS text")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        quality_rules.keep_good(docs)
        assert np.max([r.n for r in texts.mapInArrow(sizes, "n long").collect()]) < 5 << 20
    finally:
        spark.conf.set(key, before)
