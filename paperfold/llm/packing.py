"""Bounded-space online packing of token sequences.

Each partition keeps OPEN_WINDOWS open windows. A piece goes where it leaves the least
room (best fit); if it fits nowhere, the fullest window is emitted and a new one opened.
What is open at the end of a partition is merged: the pieces of the leftover windows of
MERGE_FAN partitions are packed anew, and the emptiest windows go on, round after round,
until one group is left. No task holds more than the open windows of MERGE_FAN partitions,
whatever the input.

A document longer than a window is cut; the full parts are windows of their own and the rest
is packed like any other piece. Token ids come from a public tokenizer that drops white
space, so each distinct word is encoded once.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each by
itself; an empty table gives no piece; columns besides id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import blocks as b
from paperfold.llm.store import Stages
from paperfold.session import small_batches

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_FAN = 64
END_ID = 2
CACHED_WORDS = 700_000
ENCODED_PIECES = 8192
BLOCK_BYTES = 1 << 20
LEARNED_WORDS = 16_384
HASHED_BYTES = 1 << 15
PIECE = "doc_id {kind}, start long, length long, doc_tokens long, window long, at long, open boolean, ids binary"


def vocabulary() -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    out = np.repeat(start - np.cumsum(size) + size, size)
    out += np.arange(len(out))
    return out


def hashes(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, at = b.flat(keys)
    parts = [np.zeros(0, b.U64)]
    for first, last in b.blocks(data, at, HASHED_BYTES):
        ends = at[first : last + 1] - at[first]
        parts.append(b.substring(b.prefix(data[at[first] : at[last]]), ends[:-1], ends[1:]))
    return np.concatenate(parts)


class Codes:
    """Ids of up to ``most`` strings, one after another in one array. The strings are an Arrow
    array, so a string costs its bytes and an offset instead of Python objects; its place is
    where it stands there. It is found by its hash among the sorted ones and then compared
    itself, so no table of all strings is built for a block; of strings with one hash the
    first is found, the others count as unknown."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.known = pa.array([], pa.large_string())
        self.hashes, self.order = np.zeros(0, b.U64), np.zeros(0, np.int32)
        self.ids, self.ends = np.zeros(1 << 16, np.uint16), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where the keys stand, -1 for those not known."""
        place = np.full(len(keys), -1, np.int64)
        if len(self.hashes):
            wanted = hashes(keys)
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == wanted)
            found = self.order[at[hit]]
            same = pc.equal(self.known.take(pa.array(found)), keys.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            place[hit[same]] = found[same]
        return place

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[-1])
        new = hashes(keys)
        order = np.argsort(new, kind="stable")
        at = np.searchsorted(self.hashes, new[order], "right")
        self.order = np.insert(self.order, at, (len(self.known) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, at, new[order])
        self.known = pa.concat_arrays([self.known, keys])
        self.ends = np.r_[self.ends, used + np.cumsum(sizes)]
        if len(ids) and int(ids.max()) >> 16 and self.ids.dtype == np.uint16:  # of a larger vocabulary
            self.ids = self.ids.astype(np.uint32)
        if used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids) // 4, len(ids)), self.ids.dtype)]
        self.ids[used : used + len(ids)] = ids

    def of(self, keys: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct keys, one after another, and the number of each key's ids.
        Unknown ones come from ``learn`` and are remembered while there is room."""
        place = self.places(keys)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        size = np.zeros(len(keys), np.int64)
        start = self.ends[place[old]]
        size[old] = self.ends[place[old] + 1] - start
        known, learnt = self.ids[spans(start, size[old])], np.zeros(0, np.uint32)
        if len(new):
            unknown = keys.take(pa.array(new))
            learnt, size[new] = learn(unknown)
            room = min(self.most - len(self), len(new))
            if room > 0:
                sizes = size[new[:room]]
                self.add(unknown.slice(0, room), learnt[: int(sizes.sum())], sizes)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[spans(at[old], size[old])] = known
        out[spans(at[new], size[new])] = learnt
        return out, size


class WordEncoder:
    """Token ids of texts, each distinct word encoded once.

    The tokenizer's pre-split never joins characters across space or newline, so the ids of a
    text are those of its words. A plain word (letters, digits and ASCII signs, composed
    form) is cut once more, at the changes between letters, digits and signs, where the
    pre-split cuts too; new pieces go to the tokenizer in one string, a digit between them.
    Words with an apostrophe (contractions), special tokens or any other character go there
    by themselves. Up to ``most`` words are remembered for the life of the process, as arrays,
    since other operators run in the same process later; later new words are encoded block by
    block.
    """

    SEPARATOR = "7"

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.encode(self.SEPARATOR)[0]
        self.plain = regex.compile(r"[\p{L}\p{N}!-&(-/:-@\[-`{-~]+").fullmatch
        self.pieces = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.words, self.parts = Codes(most), Codes(most)

    def encode(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words and the number of each one's ids, by way of their pieces. A
        word is several Python objects meanwhile, so a few are taken at a time."""
        found = [self.learn_some(new.slice(first, LEARNED_WORDS).to_pylist()) for first in range(0, len(new), LEARNED_WORDS)]
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def learn_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [not (self.plain(w) and is_normalized("NFC", w)) or "\u0130" in w or "<|" in w for w in words]
        cut = [[w] if alone else self.pieces(w) for w, alone in zip(words, whole, strict=True)]
        count = np.array([len(c) for c in cut])
        coded = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        by_itself = {w for w, alone in zip(words, whole, strict=True) if alone}
        ids, size = self.parts.of(coded.dictionary, lambda pieces: self.tokenized(pieces.to_pylist(), by_itself))
        which = coded.indices.to_numpy()
        upto = np.r_[0, np.cumsum(size[which])]
        last = np.cumsum(count)
        return ids[spans((np.cumsum(size) - size)[which], size[which])], upto[last] - upto[last - count]

    def tokenized(self, pieces: list[str], by_itself: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces from the tokenizer and the number of each one's ids."""
        single = np.fromiter((len(p) == 1 or p in by_itself for p in pieces), bool, len(pieces))
        alone, many = ([pieces[i] for i in np.flatnonzero(x)] for x in (single, ~single))
        ids = [self.encode(p) for p in alone]
        sizes = [np.array([len(i) for i in ids], np.int64)]
        for at in range(0, len(many), ENCODED_PIECES):  # the tokenizer's own result is many times as large
            found = self.encode(f" {self.SEPARATOR} ".join(many[at : at + ENCODED_PIECES]))
            marks = np.flatnonzero(found == self.mark)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(np.r_[-1, marks, len(found)]) - 1)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        start, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        order = np.r_[np.flatnonzero(single), np.flatnonzero(~single)]
        start[order], size[order] = np.cumsum(sizes) - sizes, sizes
        return ids[spans(start, size)], size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow finds the distinct words of the block; Python sees these only."""
        data, at = b.flat(texts)
        gap = (data == 32) | (data == 10)
        start, end = b.edges(~gap, at)
        kept = np.ascontiguousarray(data[~gap])
        coded = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int64)), pa.py_buffer(kept)).dictionary_encode()
        del gap, end, kept
        found, size = self.words.of(coded.dictionary, self.learn)
        which = coded.indices.to_numpy()
        ids = found[spans((np.cumsum(size) - size)[which], size[which])]
        ends = np.r_[0, np.cumsum(size[which])][np.searchsorted(start, at)]
        pa.default_memory_pool().release_unused()  # a reused worker holds no more than the words
        return [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str) -> WordEncoder:
    """The encoder of this process: a reused Python worker keeps its words between tasks of
    packing, and gives them up to the next other operator."""
    held = b.held("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens, by number, with the tokens used; also
    kept in the order of (used, -number)."""

    def __init__(self, size: int, most: int, number) -> None:
        self.size, self.most, self.number = size, most, number
        self.used: dict[int, int] = {}
        self.order: list[tuple[int, int]] = []

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window emitted to make room)."""
        fits = bisect_right(self.order, (self.size - length, 1))
        emitted = None
        if fits:
            used, window = self.order.pop(fits - 1)
            window = -window
        else:
            if len(self.order) >= self.most:
                emitted = -self.order.pop()[1]
                del self.used[emitted]
            used, window = 0, self.number()
        if used + length == self.size:
            self.used.pop(window, None)
        else:
            self.used[window] = used + length
            insort(self.order, (used + length, -window))
        return window, used, emitted


def numbering(round_: int, partition: int):
    """Window numbers that no other partition or round gives out."""
    state = [(round_ << 56) | (partition << 32)]

    def number() -> int:
        state[0] += 1
        return state[0] - 1

    return number


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None,
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned
    little-endian 32-bit integers as binary)."""
    path = path or vocabulary()
    small_batches(docs.sparkSession)
    stages = Stages(docs.sparkSession, "packing")
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        space = OpenWindows(window, open_windows, numbering(0, TaskContext.get().partitionId()))
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows
        done: list[tuple] = []

        def batch_of(rows: list[tuple], left_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], pa_kind), *(pa.array(c, pa.int64()) for c in cols[1:6]),
                      pa.array([left_open] * len(rows)), pa.array([i.astype("<u4").tobytes() for i in cols[6]], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "window", "at", "open", "ids"])

        for batch in batches:
            pa_kind = batch.schema.field(0).type
            for part, _, _ in b.split(batch, "text", BLOCK_BYTES):
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        number, at, emitted = space.place(len(piece))
                        if emitted is not None:
                            done += waiting.pop(emitted)
                        waiting.setdefault(number, []).append((doc, start, len(piece), len(ids), number, at, piece))
                        if number not in space.used:
                            done += waiting.pop(number)
                if sum(len(r[6]) for r in done) > 1_000_000:
                    yield batch_of(done, False)
                    done = []
        if done:
            yield batch_of(done, False)
        for rows in waiting.values():
            yield batch_of(rows, True)

    pieces = stages.put("pieces", docs.select(docs[ident].alias("doc_id"), docs[text].cast("string").alias("text"))
                        .mapInArrow(run, PIECE.format(kind=kind)))
    closed = pieces.where(~F.col("open")).select("*", F.col("window").alias("sequence_id"), F.col("at").alias("offset"))
    left = stages.put("left", pieces.where("open").select("window", "at", "length"))
    moved = merge(stages, left, window, open_windows)
    rest = pieces.where("open").join(moved, ["window", "at"])
    out = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return closed.select(*out).unionByName(rest.select(*out)).withColumnRenamed("doc_id", ident)


def team_placer(round_: int, window: int, open_windows: int):
    """Places the pieces of a team of leftover windows: the longest first, each where it
    leaves the least room. The ``open_windows`` emptiest windows stay open."""

    def run(key, rows):
        import pandas as pd

        number = numbering(round_, int(key[0]))
        rooms: list[tuple[int, int]] = []  # (room, window), ascending
        rows = rows.sort_values(["length", "window", "at"], ascending=[False, True, True])
        holder, offset = [], []
        for length in rows["length"].tolist():
            i = bisect_left(rooms, (length, -1))
            room, chosen = rooms.pop(i) if i < len(rooms) else (window, number())
            holder.append(chosen)
            offset.append(window - room)
            if room > length:
                insort(rooms, (room - length, chosen))
        still = {w for _, w in rooms[-open_windows:]}
        return pd.DataFrame({"window": rows["window"], "at": rows["at"], "length": rows["length"], "sequence_id": holder,
                             "offset": offset, "open": [w in still for w in holder]})

    return run


def merge(stages: Stages, left: DataFrame, window: int, open_windows: int) -> DataFrame:
    """Places every leftover piece in a sequence: (window, at, sequence_id, offset).

    A leftover's origin is the upper half of its window's number. A round packs the pieces
    of MERGE_FAN origins; its full windows are final, its emptiest go to the next round.
    """
    origins = 1 + (left.agg(F.max(F.shiftright("window", 32))).first()[0] or 0)
    current = left.withColumn("origin", F.shiftright("window", 32))
    settled, round_ = None, 0
    while True:
        round_ += 1
        over = origins <= MERGE_FAN
        packed = stages.put(f"merge{round_}", current.withColumn("team", F.floor(F.col("origin") / MERGE_FAN)).groupBy("team").applyInPandas(
            team_placer(round_, window, open_windows), "window long, at long, length long, sequence_id long, offset long, open boolean"))
        final = (packed if over else packed.where("NOT open")).select("window", "at", "sequence_id", "offset")
        settled = final if settled is None else settled.unionByName(final)
        if over:
            return settled
        origins = -(-origins // MERGE_FAN)
        current = packed.where("open").select("window", "at", "length", F.shiftright(F.col("sequence_id") - F.lit(round_ << 56), 32).alias("origin"))
