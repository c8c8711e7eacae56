"""Suffix arrays of byte strings by induced sorting, in numpy.

The alphabet has 256 letters, so inducing goes bucket by bucket: all suffixes of a bucket are taken
at once, in order, and their predecessors are appended to their buckets by a stable sort of one
letter. Only predecessors in the same bucket need another round.
"""

from __future__ import annotations

import numpy as np

from estuarine.llm.common import ranges


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their successors, and the leftmost of each such stretch.

    The end of the text counts as smaller than any letter, so the last suffix is larger than it.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))  # next letter against this one
    # equal letters take the class of the first letter after them that differs
    at = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    smaller = step[np.minimum(decides, n - 1)] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes."""
    n = len(text)
    letters = text.astype(np.int64)
    counts = np.bincount(letters, minlength=256)
    n_small = np.bincount(letters[smaller], minlength=256)
    out = np.full(n, -1, np.int64)
    begin = np.cumsum(counts) - counts
    large_end = begin + counts - n_small
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")]
    seed_at = np.searchsorted(text[seeds], np.arange(257))
    used = [c for c in range(256) if counts[c]]

    def send(found: np.ndarray, at: np.ndarray, forward: bool) -> None:
        """Put suffixes, in the order found, at the ends of their buckets."""
        kinds = text[found]
        by = np.argsort(kinds, kind="stable")
        per = np.bincount(kinds, minlength=256)
        hit = np.flatnonzero(per)
        if forward:
            out[ranges(at[hit], per[hit])] = found[by]
            at += per
        else:
            places = ranges(at[hit] - per[hit], per[hit])
            by = by[::-1]  # descending letters, each letter's suffixes last found first
            order = np.argsort(kinds[by], kind="stable")
            out[places] = found[by][order]
            at -= per

    # larger suffixes, from small letters to large ones
    free = begin.copy()
    if n and not smaller[-1]:
        send(np.array([n - 1]), free, True)
    for c in used:
        done = begin[c]
        while done < free[c]:
            now = out[done : free[c]]
            done = free[c]
            prev = now[now > 0] - 1
            prev = prev[~smaller[prev] & (text[prev] >= c)]
            if len(prev):
                send(prev, free, True)
        now = seeds[seed_at[c] : seed_at[c + 1]]
        prev = now[now > 0] - 1
        prev = prev[~smaller[prev]]
        if len(prev):
            send(prev, free, True)
    # smaller suffixes, from large letters to small ones
    free = begin + counts
    for c in reversed(used):
        done = begin[c] + counts[c]
        while done > free[c]:
            now = out[free[c] : done][::-1]
            done = free[c]
            prev = now[now > 0] - 1
            prev = prev[smaller[prev]]
            if len(prev):
                send(prev, free, False)
        now = out[begin[c] : large_end[c]][::-1]
        prev = now[now > 0] - 1
        prev = prev[smaller[prev]]
        if len(prev):
            send(prev, free, False)
    return out


def name(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring among the distinct ones; `order` sorts them."""
    lengths = ends[order]
    differs = np.ones(len(order), bool)
    live = np.arange(1, len(order))
    live = live[lengths[1:] == lengths[:-1]]
    differs[live] = False
    a, b, n = order[live - 1], order[live], lengths[live]
    k = 0
    while len(live):
        unequal = text[a + k] != text[b + k]
        differs[live[unequal]] = True
        k += 1
        go = ~unequal & (k < n)
        live, a, b, n = live[go], a[go], b[go], n[go]
    return np.cumsum(differs) - 1


def rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: ranks of prefixes, doubled until all differ."""
    n, rank, reach = len(names), names.astype(np.int64), 1
    while True:
        after = np.full(n, 0, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
        rank, reach = new, reach * 2
        if n == 0 or rank.max() == n - 1 or reach >= n:
            return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray) -> np.ndarray:
    smaller, leftmost = classify(text)
    if len(leftmost) > 1:
        ends = np.full(len(text), 0, np.int64)
        ends[leftmost] = np.diff(leftmost, append=len(text) - 1) + 1
        rough = induce(text, smaller, leftmost)
        is_left = np.zeros(len(text), bool)
        is_left[leftmost] = True
        order = rough[is_left[rough]]
        names = np.empty(len(text), np.int64)
        names[order] = name(text, order, ends)
        leftmost = leftmost[rank_names(names[leftmost])]
    return induce(text, smaller, leftmost)


def permuted_prefixes(text: np.ndarray, suffixes: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix, in text order, with the one before it in the array.

    Where the letters before two neighbours are equal, the value is one less than the value to its
    left, so only the others are compared letter by letter, and those marked `fresh`. Values are
    exact up to `most`.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    here = np.arange(n)
    known = before >= 0
    same = known & (here > 0) & (before > 0)
    same[same] = text[here[same] - 1] == text[before[same] - 1]
    # the neighbour one to the left must be the same one moved
    same[1:] &= known[:-1]
    same &= ~fresh
    direct = np.flatnonzero(~same)
    out = np.zeros(n, np.int64)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (n + 1, 8), (1, 1))
    a, b = direct[known[direct]], before[direct[known[direct]]]
    at, k = a, 0
    while len(at) and k < most:
        x = np.ascontiguousarray(words[np.minimum(a + k, n)]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[np.minimum(b + k, n)]).view(np.uint64).ravel()
        low = x & (~x + np.uint64(1))
        part = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        out[at] += np.minimum(part, np.maximum(np.minimum(n - (a + k), n - (b + k)), 0))
        go = (x == 0) & (np.maximum(a, b) + k + 8 < n)
        a, b, at = a[go], b[go], at[go]
        k += 8
    origin = np.maximum.accumulate(np.where(~same, here, 0))
    return np.maximum(out[origin] - (here - origin), 0)
