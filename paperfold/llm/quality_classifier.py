"""Quality: naive Bayes support vectors over token n-grams.

Indicators of token unigrams and bigrams, and of a token that follows itself, are scaled by class log-count ratios; a linear
hinge-loss model is fitted to them by dual coordinate descent.

Edge cases: as in ``toxicity``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm import nb_features as nb

ORDERS = (1, 2)
FITTED_PER_CLASS = 2000
PASSES = 20
COST = 0.1
FEATURES = nb.Features(nb.tokens, ORDERS, echo=True)


def dual_coordinate_descent(found: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Minimises w.w / 2 + COST * sum of hinge losses: one dual variable of [0, COST] at a
    time, in a random order that is the same for the same sample. The last weight is the
    bias (a feature that is always 1)."""
    sign = np.where(y > 0, 1.0, -1.0)
    values = [ratios[f] for f in found]
    square = np.array([v @ v for v in values]) + 1.0
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = sign[i] * (values[i] @ w[found[i]] + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), COST)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[found[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * COST:
            break
    return w * ratios, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", fitted: int = FITTED_PER_CLASS) -> nb.Model:
    return nb.train(docs, labels, label, rows, FEATURES, fitted, dual_coordinate_descent, "quality")


def score(docs: DataFrame, model: nb.Model) -> DataFrame:
    """(doc_id, score): the margin on a scale of 0 to 1; 0.5 is the separating plane."""
    return nb.score(docs, FEATURES, model).select("doc_id", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
