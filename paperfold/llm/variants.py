"""Spelling variants: words at one edit, by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. Every word generates the full one-edit neighbourhood of
its reduced form: the form itself, and every deletion, replacement and insertion of a symbol.
These meet the reduced vocabulary in a join, and pairs are verified on the original strings.
Reduced words are 64-bit rolling hashes, so a neighbour costs one multiplication at any
length; a hash that two forms share only adds a pair to verify. Neighbours that no word has
are left out before the shuffle by a bit table of fixed size (2 ** SLOT_BITS bits), built by
Spark's bitmap functions. The number of symbols follows the vocabulary, so that the words that
share a reduced form stay few.

Edge cases: null and empty texts have no words; a null id counts as an empty text in the hash
that decides about deletions; a repeated row counts again, as does each of its words; equal
words are one; ties of n go to the smaller word in code-point order; words without a near
word have n_near 0 and are their own root; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages, text_of

LEAST_LENGTH = 7
LEAST_OCCURRENCES = 2
DOMINANCE = 10
SLOT_BITS = 26
BITMAP = 1 << 15  # bits of one of Spark's bitmaps
FEWEST_SYMBOLS, MOST_SYMBOLS = 4, 16
WORDS_AT_ONCE = 1 << 15
LETTERS_AT_ONCE = 1 << 18
SHORT = 64  # bytes; longer words are hashed one by one
CRC_POLYNOMIAL = 0xEDB88320
U64 = np.uint64


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(CRC_POLYNOMIAL), table >> np.uint32(1))
    return table


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of the substrings, each continued from a state; one step for the k-th bytes of all."""
    table, size = crc_table(), end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= SHORT]
    at, left = start[order], size[order]
    crc = state[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k, "left"))  # those with more than k bytes
        crc[:n] = table[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.zeros(len(start), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def runs(data: np.ndarray, at: np.ndarray, idents: list, every: int | None, least: int) -> pa.Array:
    """Words of all texts: runs of letters up to U+00FF, only A-Z lower-cased, of ``least``
    code points or more. Where ``every`` divides the crc32 of id and run, a code point is
    left out."""
    lead = data == 0xC3  # U+00C0 to U+00FF, and nothing else
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | lead
    letter[1:] |= lead[:-1]
    data = b.LOWER[data]
    start, end = b.edges(letter, at)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    length = points[end] - points[start]
    use = length >= least
    start, end, length = start[use], end[use], length[use]
    cut = np.zeros(len(start), np.int64)
    keep = np.zeros(len(data) + 1, np.int64)
    if every:
        doc = np.searchsorted(at, start, "right") - 1
        state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in idents], np.uint32)
        h = crc32(data, start, end, state[doc]).astype(np.int64)
        hit = np.flatnonzero(h % every == 0)
        where = np.flatnonzero((data & 0xC0) != 0x80)[points[start[hit]] + h[hit] % length[hit]]
        cut[hit] = 1 + lead[where]
        length[hit] -= 1
        gone = np.r_[where, where[lead[where]] + 1]
    else:
        gone = np.zeros(0, np.int64)
    use = length >= least
    start, end, cut = start[use], end[use], cut[use]
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    inside = np.cumsum(keep[:-1]) > 0
    inside[gone] = False
    ends = np.r_[0, np.cumsum(end - start - cut)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside])))


def vocabulary(docs: DataFrame, ident: str = "doc_id", text: str = "text", every: int | None = None, least_length: int = LEAST_LENGTH,
               least: int = LEAST_OCCURRENCES) -> DataFrame:
    """(word, n): distinct words and their occurrences; blocks are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in b.split(batch, "text"):
                coded = runs(data, at, rows.column(0).to_pylist(), every, least_length).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(docs[ident].cast("string").alias("id"), text_of(docs[text].cast("string")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbols_for(words: int, shortest: int) -> int:
    """The fewest symbols that make at least four reduced words of the shortest length a word."""
    most = range(FEWEST_SYMBOLS, MOST_SYMBOLS + 1)
    return next((s for s in most if s ** shortest >= 4 * words), MOST_SYMBOLS)


class Reduced:
    """The reduced forms of some words: prefix sums of symbol * BASE ** position."""

    def __init__(self, words: pa.Array, symbols: int) -> None:
        texts = words.to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U64)
        self.n = symbols
        self.symbol = (points * U64(0x9E3779B1) >> U64(13)) % U64(symbols)
        self.at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        self.word = b.owner(self.at)
        self.power = b.powers(int(np.diff(self.at).max(initial=0)) + 2, b.BASE)
        self.place = np.arange(len(points)) - self.at[self.word]
        sums = np.r_[U64(0), np.cumsum((self.symbol + U64(1)) * self.power[self.place])]
        self.whole = sums[self.at[1:]] - sums[self.at[:-1]]
        self.before = sums[:-1] - sums[self.at[:-1]][self.word]
        self.upto = sums[1:] - sums[self.at[:-1]][self.word]

    def keys(self) -> np.ndarray:
        return b.mix(self.whole)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of the one-edit neighbourhood, one kind and symbol after another."""
        power, whole = self.power[self.place], self.whole[self.word]
        yield np.arange(len(self.whole)), self.keys()
        yield self.word, b.mix(self.before + (whole - self.upto) * b.BASE_INV)
        for step in range(1, self.n):
            other = (self.symbol + U64(step)) % U64(self.n)
            yield self.word, b.mix(whole + (other - self.symbol) * power)
        after = self.power[np.diff(self.at)]
        for new in range(self.n):
            yield self.word, b.mix(self.before + U64(new + 1) * power + (whole - self.before) * b.BASE)
            yield np.arange(len(self.whole)), b.mix(self.whole + U64(new + 1) * after)


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of words and letters; a longer word is one by itself."""
    _, at = b.flat(batch.column(0))
    for first, last in b.blocks(np.arange(0), at, LETTERS_AT_ONCE):
        for lo in range(first, last, WORDS_AT_ONCE):
            yield batch.slice(lo, min(WORDS_AT_ONCE, last - lo))


def near(words: DataFrame, stages: Stages, symbols: int) -> DataFrame:
    """(word, other, other_n): every word with every word at exactly one edit."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(Reduced(part.column(0), symbols).keys().view(np.int64)), part.column(0), part.column(1)], names=["key", "other", "other_n"])

    reduced = stages.put("reduced", words.select("word", "n").mapInArrow(reduce, "key long, other string, other_n long"))
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    bits = reduced.groupBy(F.floor(slot / BITMAP).alias("number")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("bits")).collect()  # 2 ** SLOT_BITS bits in all
    table = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for row in bits:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[row["number"] * (BITMAP >> 3) :][: len(part)] = part
    sent = words.sparkSession.sparkContext.broadcast(table)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sent.value
        for batch in batches:
            for part in pieces_of(batch):
                found = []
                for word, key in Reduced(part.column(0), symbols).neighbours():
                    slot = (key >> U64(64 - SLOT_BITS)).astype(np.int64)
                    some = np.flatnonzero(taken[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    found.append((word[some], key[some].view(np.int64)))
                word, key = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((key, word))
                word, key = word[order], key[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), part.column(0).take(pa.array(word[new]))], names=["key", "word"])

    asked = words.select("word").mapInArrow(generate, "key long, word string")
    close = (F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    return asked.join(reduced, "key").where(close).select("word", "other", "other_n")


def roots(forms: DataFrame, stages: Stages) -> DataFrame:
    """(word, root): forms followed to the last. n grows tenfold a step, so chains are short;
    a round doubles the steps followed."""
    known, round_ = forms.select("word", F.col("form").alias("root")), 0
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stages.put(f"roots{round_}", known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")))
        if round_:
            stages.drop(f"roots{round_ - 1}")
        known, round_ = moved.select("word", "root"), round_ + 1
        if not moved.where("moved").limit(1).count():
            return known


def group(docs: DataFrame, ident: str = "doc_id", text: str = "text", every: int | None = None, least_length: int = LEAST_LENGTH,
          least: int = LEAST_OCCURRENCES, dominance: int = DOMINANCE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``least`` times."""
    stages = Stages(docs.sparkSession, "variants")
    words = stages.put("words", vocabulary(docs, ident, text, every, least_length, least))
    symbols = symbols_for(words.count(), least_length)
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("word")))
    judged = near(words, stages, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(judged, "word", "left")
    wins = -F.col("best.rank") >= dominance * F.col("n")
    judged = stages.put("judged", judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.word")).alias("form"),
                                                F.when(wins, -F.col("best.rank")).alias("form_n")))
    stages.drop("reduced", "words")
    ends = roots(judged.where("form IS NOT NULL"), stages)
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
