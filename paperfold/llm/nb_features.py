"""Binary n-gram features scaled by naive Bayes log-count ratios.

Features are hashed n-grams of units (characters or tokens) in 2 ** BITS places. How many
labelled texts of each class hold a feature is counted over all training rows by Spark; those
of LEAST_TEXTS texts or more stay, each scaled by its log-count ratio, and the regularised fit
weighs them. The fit takes a bounded, hash-ordered sample of the labelled texts (its bound is
a parameter). It can move the weights of features that the sample holds only, so these alone,
with their ratios from all texts, reach the driver and the tasks; every text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages, text_of

BITS = 22
LEAST_TEXTS = 2
BROADCAST_TEXTS = 2_000_000
BLOCK_BYTES = 1 << 18
SMOOTHING = 1.0
# Classes of bytes for tokens: 0 white space, 1 letters, digits and non-ASCII, 2 the rest.
KINDS = np.full(256, 2, np.uint8)
KINDS[b.SPACE] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def characters(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, each text with a space before and after."""
    texts = [f" {(t or '').lower()} " for t in rows.column(1).to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(b.U64) * b.BASE, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def tokens(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of word characters and runs of other signs, case kept."""
    kind = KINDS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.r_[start[1:], len(data)]
    real = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    return b.substring(b.prefix(data), start, end), np.searchsorted(start, at)


@dataclass(frozen=True)
class Features:
    units: Callable
    orders: tuple[int, ...]
    echo: bool = False  # one more feature: two equal units in a row

    def each(self, batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[tuple]:
        """(rows, features, documents): the distinct (document, feature) pairs of a block, of
        the wanted features if a table of them is given."""
        for batch in batches:
            for rows, data, at in b.split(batch, "text", BLOCK_BYTES):
                h, unit_at = self.units(rows, data, at)
                doc = b.owner(unit_at)
                kind = np.uint32 if len(rows) <= 1 << (32 - BITS) else np.int64  # short keys sort faster
                upper = doc.astype(kind) << kind(BITS)
                found = []
                g = h
                for n in range(1, max(self.orders) + 1):
                    if n > 1:
                        g = g[:-1] * b.NGRAM + h[n - 1 :]
                    if n not in self.orders or not len(g):
                        continue
                    place = ((g ^ (g >> b.U64(29))) * b.U64(0xBF58476D1CE4E5B9) >> b.U64(64 - BITS)).astype(kind)
                    use = doc[: len(g)] == doc[n - 1 :]
                    if wanted is not None:
                        use &= wanted[place]
                    found.append((upper[: len(g)] | place)[use])
                if self.echo and len(h) > 1 and (wanted is None or wanted[0]):
                    found.append(upper[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
                pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, kind)
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:] != pairs[:-1]
                pairs = pairs[new]
                yield rows, (pairs & kind((1 << BITS) - 1)).astype(np.int64), (pairs >> kind(BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, stages: Stages) -> DataFrame:
    """(doc_id, pair, y): one row of each distinct text among all training rows, named by the
    hash of its id and text, so that a text with many copies counts once. Several labels of
    one id or text: the largest holds. No text is shuffled."""
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train)
         .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    texts = docs.select("doc_id", text_key().alias("key")).join(y, "doc_id")
    once = texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    return stages.put("once", once.select("doc_id", F.xxhash64("doc_id", "key").alias("pair"), "y"))


def text_key() -> Column:
    return F.xxhash64(text_of(F.col("text").cast("string")))


def texts_of(docs: DataFrame, some: DataFrame, few: bool) -> DataFrame:
    """(doc_id, text, y) of labelled rows. They are broadcast if they are few, so that the
    documents are read where they lie; else the join is Spark's."""
    rows = docs.select("doc_id", text_of(F.col("text").cast("string")).alias("text"), F.xxhash64("doc_id", text_key()).alias("pair"))
    some = some.select("pair", "y")
    return rows.join(F.broadcast(some) if few else some, "pair").select("doc_id", "text", "y")


def class_counts(rows: DataFrame, features: Features) -> DataFrame:
    """(place, ones, zeros): texts of either class that hold the feature; place -1 counts
    the texts themselves. A task sums what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for part, places, doc in features.each(batches, None):
            y = part.column(2).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                np.add.at(sums[c], places[y[doc] == c], 1)
                texts[c] += (y == c).sum()
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[texts[1], sums[1][used].astype(np.int64)]), pa.array(np.r_[texts[0], sums[0][used].astype(np.int64)])],
                                         names=["place", "ones", "zeros"])

    return rows.mapInArrow(run, "place int, ones long, zeros long").groupBy("place").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def chosen(docs: DataFrame, once: DataFrame, features: Features, per_class: int) -> DataFrame:
    """(doc_id, y, places): at most ``per_class`` of the labelled texts of each class, in hash
    order, with their features."""
    some = [once.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "pair").limit(per_class) for c in (0, 1)]
    picked = texts_of(docs, some[0].unionByName(some[1]), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, doc in features.each(batches, None):
            ends = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "y", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, y int, places array<int>")


def log_count_ratios(counts: DataFrame, picked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places, ratios) of the sample's features that LEAST_TEXTS of all texts hold; the sample
    bounds them."""
    whole = counts.where("place = -1").first()
    ones, zeros = (float(whole["ones"]), float(whole["zeros"])) if whole else (0.0, 0.0)
    if not ones or not zeros:
        return np.zeros(0, np.int64), np.zeros(0)
    ratio = F.log((F.col("ones") + SMOOTHING) / (ones + 2 * SMOOTHING)) - F.log((F.col("zeros") + SMOOTHING) / (zeros + 2 * SMOOTHING))
    held = picked.select(F.explode("places").alias("place")).distinct()
    told = counts.where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS).join(held, "place").select("place", ratio.alias("ratio")).toArrow()
    places, ratios = told["place"].to_numpy().astype(np.int64), told["ratio"].to_numpy()
    order = np.argsort(places)
    return places[order], ratios[order]


def collected(picked: DataFrame, places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sample's texts as positions in ``places``, and their classes."""
    wanted = picked.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(1 << BITS, -1, np.int32)
        at[wanted.value] = np.arange(len(wanted.value))
        for batch in batches:
            lists = batch.column(2)
            flat = at[lists.flatten().to_numpy()]
            upto = np.r_[0, np.cumsum(flat >= 0)]
            ends = upto[np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[flat >= 0]))], names=["doc_id", "y", "places"])

    rows = picked.mapInArrow(run, picked.schema).toArrow()
    parts, ids = [], rows["doc_id"].to_numpy()
    for chunk in rows["places"].chunks:
        flat, ends = chunk.flatten().to_numpy(), np.r_[0, np.cumsum(chunk.value_lengths().to_numpy())]
        parts += [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    order = np.argsort(ids, kind="stable")
    return [parts[i] for i in order], rows["y"].to_numpy()[order]


def sample(docs: DataFrame, once: DataFrame, features: Features, places: np.ndarray, per_class: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The chosen texts as positions in ``places``, and their classes, without a stage."""
    return collected(chosen(docs, once, features, per_class), places)


def score(docs: DataFrame, features: Features, model: Model, ident: str = "doc_id") -> DataFrame:
    """(id, margin) of every row: the summed weights of its distinct features and the bias."""
    some = model.weights != 0  # at most the features of the sample
    sent = docs.sparkSession.sparkContext.broadcast((model.places[some].astype(np.int32), model.weights[some], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = sent.value
        weight = np.zeros(1 << BITS)
        weight[places] = weights
        table = weight != 0
        for part, found, doc in features.each(batches, table):
            margin = bias + np.bincount(doc, weight[found], minlength=len(part))[: len(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(margin)], names=["doc_id", "margin"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(docs[ident].alias("doc_id"), text_of(docs["text"].cast("string")).alias("text")).mapInArrow(run, f"doc_id {kind}, margin double")


def train(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, features: Features, fitted: int,
          fit: Callable[[list[np.ndarray], np.ndarray, np.ndarray, float], tuple[np.ndarray, float]], name: str) -> Model:
    """Counts all labelled texts and fits at most ``fitted`` of each class.
    Without both classes among them the model has no feature and its bias is the log odds of
    the only class. The intercept follows the balance of the classes among all labels."""
    stages = Stages(docs.sparkSession, name)
    known = labels.where(F.col(label).isNotNull()).where(train_on).agg(F.sum(F.col(label).cast("int")).alias("ones"), F.count(F.lit(1)).alias("n")).first()
    prior = math.log(((known["ones"] or 0) + 1e-6) / (known["n"] - (known["ones"] or 0) + 1e-6))
    once = labelled(docs, labels, label, train_on, stages)
    counts = stages.put("counts", class_counts(texts_of(docs, once, once.count() <= BROADCAST_TEXTS), features))
    picked = stages.put("sample", chosen(docs, once, features, fitted))
    places, ratios = log_count_ratios(counts, picked)
    model = Model(places, ratios, max(-30.0, min(30.0, prior)))
    if len(places):
        model = Model(places, *fit(*collected(picked, places), ratios, prior))
    stages.drop("counts", "once", "sample")
    return model
