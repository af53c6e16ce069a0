"""Toxicity: a logistic classifier over character n-grams scaled by naive Bayes ratios.

Edge cases: null and empty texts score by the bias alone; repeated rows score alike; labels
that are null, of unknown ids or repeated with different values: ignored, ignored, the
largest holds; without labels of both classes every score is that of the only class (0.5
without any); an empty table gives an empty result; other columns are no input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm import nb_features as nb

ORDERS = (3, 4, 5)
FITTED_PER_CLASS = 2000
STEPS = 300
RATE = 0.5
DECAY = 1e-4
BLOCK = 256  # documents
FEATURES = nb.Features(nb.characters, ORDERS)


def logistic(found: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) by gradient steps of AdaGrad; the intercept is set
    back from the balance of the sample to that of all labels."""
    blocks = []  # documents, their columns and owners: small arrays keep the driver small
    for i in range(0, len(found), BLOCK):
        some = found[i : i + BLOCK]
        blocks.append((slice(i, i + len(some)), np.concatenate(some), np.repeat(np.arange(len(some), dtype=np.int16), [len(f) for f in some])))
    w, bias = np.zeros(len(ratios)), 0.0
    sums, bias_sum = np.full(len(ratios), 1e-8), 1e-8
    for _ in range(STEPS):
        margin, scaled = np.full(len(y), bias), ratios * w
        for docs, col, doc in blocks:
            margin[docs] += np.bincount(doc, scaled[col], minlength=docs.stop - docs.start)
        off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / max(len(y), 1)
        slope = np.zeros(len(w))
        for docs, col, doc in blocks:
            np.add.at(slope, col, off[docs][doc])
        slope = ratios * slope + DECAY * w
        sums += slope**2
        bias_sum += off.sum() ** 2
        w -= RATE * slope / np.sqrt(sums)
        bias -= RATE * off.sum() / np.sqrt(bias_sum)
    balance = np.log((y.sum() + 1e-6) / (len(y) - y.sum() + 1e-6))
    return w * ratios, float(bias - balance + prior)


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", fitted: int = FITTED_PER_CLASS) -> nb.Model:
    return nb.train(docs, labels, label, rows, FEATURES, fitted, logistic, "toxic")


def score(docs: DataFrame, model: nb.Model) -> DataFrame:
    """(doc_id, score): the probability that a text is toxic."""
    return nb.score(docs, FEATURES, model).select("doc_id", (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
