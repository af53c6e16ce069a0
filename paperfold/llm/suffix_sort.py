"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their successor. The leftmost S
suffixes (LMS) are sorted by inducing from their first characters, equal LMS substrings get
equal names, the string of names is sorted recursively, and its order induces the whole
array. Induction runs bucket by bucket: all suffixes of a bucket place their predecessors
at once, and a run of equal characters takes one step per repetition. Where the names of a
level outgrow MOST_BUCKETS, steps by bucket would not be vectors any more, and that level's
string is sorted by doubling of ranks.
"""

from __future__ import annotations

import numpy as np

MOST_BUCKETS = 4096
WORD = 8


def by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of an integer string: ranks of 1, 2, 4 ... characters."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order][1:] != key[order][:-1])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (``seeds``, by bucket ascending).

    L pass: from the lowest bucket up, what is in place sets its L predecessors at the
    heads of their buckets. S pass: from the highest bucket down, S predecessors at tails.
    """
    n, kinds = len(text), len(sizes)
    narrow = np.uint8 if kinds <= 256 else np.uint16
    heads = np.zeros(kinds + 1, np.int64)
    np.cumsum(sizes, out=heads[1:])
    array = np.full(n, -1, np.int64)
    seed_at = np.searchsorted(text[seeds], np.arange(kinds + 1))
    larger = np.zeros(kinds, np.int64)  # L suffixes set so far, by bucket

    def put(found: np.ndarray, forward: bool, count: np.ndarray) -> None:
        """Sets suffixes, in the order given, at the free heads (or tails) of their buckets."""
        if not len(found):
            return
        chars = text[found]
        order = np.argsort(chars.astype(narrow), kind="stable")  # radix sort up to 16 bits
        chars, found = chars[order], found[order]
        first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        each, amount = chars[first], np.diff(np.r_[first, len(chars)])
        nth = np.arange(len(chars)) - np.repeat(first, amount)
        if forward:
            array[heads[chars] + count[chars] + nth] = found
        else:
            array[heads[chars + 1] - 1 - count[chars] - nth] = found
        count[each] += amount

    if not small[n - 1]:  # the last suffix is L: only the end follows it
        put(np.array([n - 1]), True, larger)
    for c in np.flatnonzero(sizes):
        lo, done = heads[c], 0
        while done < larger[c]:  # L suffixes of this bucket, with those that they add to it
            part = array[lo + done : lo + larger[c]] - 1
            done = int(larger[c])
            part = part[part >= 0]
            put(part[~small[part]], True, larger)
        part = seeds[seed_at[c] : seed_at[c + 1]] - 1
        part = part[part >= 0]
        put(part[~small[part]], True, larger)
    smaller = np.zeros(kinds, np.int64)
    for c in np.flatnonzero(sizes)[::-1]:
        hi, done = heads[c + 1], 0
        while done < smaller[c]:
            part = array[hi - smaller[c] : hi - done][::-1] - 1
            done = int(smaller[c])
            part = part[part >= 0]
            put(part[small[part]], False, smaller)
        part = array[heads[c] : heads[c] + larger[c]][::-1] - 1
        part = part[part >= 0]
        put(part[small[part]], False, smaller)
    return array


def suffix_array(text: np.ndarray, kinds: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of an integer string in ascending order; a suffix
    that is a prefix of another comes first."""
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    kinds = int(text.max()) + 1 if kinds is None else kinds
    if kinds > MOST_BUCKETS:
        return by_doubling(text)
    text = text.astype(np.intp)
    # S if the next different character is larger; the end counts as smallest
    change = np.flatnonzero(text[1:] != text[:-1])
    small = np.zeros(n, bool)
    if len(change):
        rises = text[change + 1] > text[change]
        small[: change[-1] + 1] = np.repeat(rises, np.diff(np.r_[-1, change]))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text, minlength=kinds)
    if len(lms) < 2:
        return induce(text, small, lms, sizes)
    rough = induce(text, small, lms[np.argsort(text[lms], kind="stable")], sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    names = name(text, small, lms, rough)
    kinds = int(names.max()) + 1
    order = suffix_array(names, kinds) if kinds < len(lms) else np.argsort(names)
    return induce(text, small, lms[order], sizes)


def name(text: np.ndarray, small: np.ndarray, lms: np.ndarray, rough: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, by place: equal ones equal, in ascending order."""
    n = len(text)
    rank_of = np.zeros(n, np.int64)
    rank_of[lms] = np.arange(len(lms))
    length = np.r_[lms[1:] - lms[:-1] + 1, n - lms[-1]]
    a, b = rough[:-1], rough[1:]
    la, lb = length[rank_of[a]], length[rank_of[b]]
    last = lms[-1]
    differ = (la != lb) | (a == last) | (b == last)
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        unequal = text[a[live] + k] != text[b[live] + k]
        differ[live[unequal]] = True
        live = live[~unequal]
        k += 1
        live = live[la[live] > k]
    names = np.zeros(len(lms), np.int64)
    names[rank_of[rough[1:]]] = np.cumsum(differ)
    return names


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """PLCP[i]: the length that suffix i shares with its predecessor in the array (0 for
    the first). Where the characters before both differ it is measured, eight bytes a step;
    everywhere else it is that of the position before, less one."""
    n = len(text)
    before = np.full(n, -1, np.int64)  # the predecessor, by place
    before[array[1:]] = array[:-1]
    own = (before < 0) | (before == 0)
    own[0] = True
    rest = np.flatnonzero(~own)
    own[rest] = text[rest - 1] != text[before[rest] - 1]
    at = np.flatnonzero(own)
    padded = np.zeros(n + WORD, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, WORD), (1, 1))
    shared = np.zeros(n, np.int64)
    live = at[before[at] >= 0]
    x, y = live.copy(), before[live].copy()
    while len(live):
        most = n - np.maximum(x, y)
        equal = (words[np.minimum(x, n)] == words[np.minimum(y, n)])
        count = np.where(equal.all(1), WORD, equal.argmin(1))
        count = np.minimum(count, most)
        shared[live] += count
        go = count == WORD
        live, x, y = live[go], x[go] + WORD, y[go] + WORD
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(shared[source] - (np.arange(n) - source), 0)
