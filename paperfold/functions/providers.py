"""Plug points for models: embedder, reranker. The defaults are deterministic."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.text import as_col, compact

TOKEN = re.compile(r"[a-z0-9]+")


def hashing_embedder(dimension: int = 64):
    """Arrow UDF: text -> token counts over md5 buckets (exact in float; the cosine
    normalises). One text at a time leaves the Arrow batch, whose bytes ``small_batches``
    bounds, and all vectors of a batch are one array."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        slot: dict[str, int] = {}
        counts = np.zeros((len(texts), dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            tokens = TOKEN.findall((text.as_py() or "").lower())
            for t in tokens:
                if t not in slot:
                    slot[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimension
            counts[i] = np.bincount([slot[t] for t in tokens], minlength=dimension)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts.ravel(), pa.float32()))

    return embed


def token_set(c: Column | str) -> Column:
    lowered = F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(compact(lowered), " "), lambda t: t != ""))


def lexical_overlap(query: Column | str, text: Column | str) -> Column:
    """Default reranker: share of the query's distinct tokens found in the text."""
    q = token_set(query)
    return F.size(F.array_intersect(q, token_set(text))) / F.greatest(F.size(q), F.lit(1))


def dimension_violations(vectors: Column | str, dimension: int) -> Column:
    return F.size(as_col(vectors)) != dimension
