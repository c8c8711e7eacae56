"""Periodic runs of words by multi-scale minimizers.

A run is a longest stretch of words that repeats with a period q. At a scale of k words, periods of
k / 1.5 to k are found: every place gets a hash of the k words from it on, and windows of k / 3 places
their smallest hash, the minimizer. In a run of three periods two windows a period apart hold the same
places of it, so their minimizers are equal and a period apart, and since k words are a period or more,
no equal place lies between them. So equal minimizers that follow each other at such a distance are
the seeds, and each is extended word by word in both directions. Periods below the first scale are
found by comparing the words with themselves directly, lag by lag.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import ranges, slices, starts, strings
from estuarine.session import spread

#: Periods up to this are compared lag by lag; the first scale has one and a half times as many words.
SHORT = 16
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(k, largest period below the scale) until the periods are over `longest`."""
    below = SHORT
    while below < longest:
        k = below * 3 // 2
        yield k, below
        below = k


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))))


class Grams:
    """Hashes of the k words from every place on, for rising k; those of 2, 4, 8 ... words are made once."""

    def __init__(self, words: np.ndarray):
        self.size, self.hashes = 1, _mixed(words.astype(np.uint64) + np.uint64(1))

    def of(self, k: int) -> np.ndarray:
        while 2 * self.size <= k:
            self.hashes = _joined(self.hashes[: -self.size], self.hashes[self.size :])
            self.size *= 2
        over = k - self.size
        return _joined(self.hashes[:-over], self.hashes[over:]) if over else self.hashes


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash, the first of equal ones, of some window of `width` places."""
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def seeds(grams: np.ndarray, k: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) where equal minimizers follow each other at a distance over `below` and up to k."""
    at = minimizers(grams, 2 * (below + 1) - k + 1)
    order = np.argsort(grams[at], kind="stable")
    value, place = grams[at[order]], at[order]
    gap = np.diff(place)
    hit = np.flatnonzero((value[1:] == value[:-1]) & (gap > below) & (gap <= k))
    return place[hit], gap[hit]


def extent(words: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """Start and end of the longest stretch around `place` whose words equal those a period later."""

    def matched(a: np.ndarray, b: np.ndarray) -> int:
        done, step = 0, 64
        while done < len(a):
            part = a[done : done + step] != b[done : done + step]
            if part.any():
                return done + int(part.argmax())
            done += len(part)
            step *= 2
        return done

    right = matched(words[place : len(words) - period], words[place + period :])
    left = matched(words[:place][::-1], words[period : place + period][::-1])
    return place - left, place + right + period


def lag_runs(words: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches of at least `least` words that repeat at `period`."""
    same = np.flatnonzero(words[period:] != words[:-period])
    first = np.concatenate(([0], same + 1))
    last = np.concatenate((same, [len(words) - period]))
    keep = last - first + period >= least
    return first[keep], last[keep] + period


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """All runs as rows (text, start, length, period), by text, start and period.

    `words` are the codes (0 or more) of several texts one after another, `lengths` their words. A run has its
    smallest period, at least `least` words and at least `times` (3 or more) periods.
    """
    at = starts(lengths)
    found: list[tuple[int, int, int, int]] = []

    def apart(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts with a word of its own after each, and where each begins."""
        n = lengths[chosen]
        begin = starts(n + 1)
        out = np.empty(begin[-1], np.int64)
        out[ranges(begin[:-1], n)] = words[ranges(at[chosen], n)]
        out[begin[1:] - 1] = -1 - np.arange(len(chosen))
        return out, begin

    chosen = np.flatnonzero(lengths >= least)
    if len(chosen):
        text, begin = apart(chosen)
        for period in range(1, SHORT + 1):
            first, last = lag_runs(text, period, max(least, times * period))
            which = np.searchsorted(begin, first, "right") - 1
            found += zip(chosen[which].tolist(), (first - begin[which]).tolist(), (last - first).tolist(), itertools.repeat(period), strict=False)
        longest = int(lengths.max()) // times
        grams = Grams(text)
        for k, below in scales(longest):
            enough = lengths[chosen] >= max(least, times * (below + 1))
            if enough.sum() < len(chosen) // 2 or not enough.any():  # most texts are too short from here on
                chosen = chosen[enough]
                if not len(chosen):
                    break
                text, begin = apart(chosen)
                grams = Grams(text)
            if len(text) < k:
                break
            place, period = seeds(grams.of(k), k, below)
            known: dict[int, int] = {}
            for m, q in sorted(zip(place.tolist(), period.tolist(), strict=True)):
                if known.get(q, 0) > m:
                    continue
                a, b = extent(text, m, q)
                known[q] = b - q
                if b - a >= max(least, times * q):
                    i = int(np.searchsorted(begin, a, "right")) - 1
                    found.append((int(chosen[i]), a - int(begin[i]), b - a, q))
    best: dict[tuple[int, int, int], int] = {}
    for i, a, n, q in found:  # a stretch also repeats at multiples of its period
        best[i, a, n] = min(q, best.get((i, a, n), q))
    rows = sorted((i, a, q, n) for (i, a, n), q in best.items())
    return np.array(rows, np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def planted(name: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the run to be put into a text of n words, for a tenth of the ids."""
    if name is None or n == 0:
        return None
    h = zlib.crc32(str(name).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def summary(split: list[bytes], runs: np.ndarray) -> tuple:
    """The result's columns for one text's words and its rows (start, length, period)."""
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist())
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(split)).hexdigest()
    best = runs[0].tolist()
    for row in runs[1:].tolist():
        if row[1] * best[2] > best[1] * row[2]:
            best = row
    a, n, q = best
    cover = np.zeros(len(split) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = itertools.compress(split, (np.cumsum(cover[:-1]) == 0).tolist())
    return len(runs), a, n, q, 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_runs, the run of the largest exponent, and hashes of all runs and of the words kept.

    Words are what white space separates, numbered from 0. A run is a stretch with smallest period q and at
    least max(`least`, `times` * q) words (`times` is 3 or more) that no neighbouring word extends. `start`, `length`, `period`
    and `exponent_milli` (1000 * length / period, cut) are those of the run with the largest length / period,
    ties to the smallest start, then period, and null without a run. `runs_sha256` is taken over the
    lines "start,length,period" by start and period. Words that a run holds after its first period are
    dropped; `collapsed_sha256` is taken over the rest, joined by blanks.

    `plant` first puts a run into every text whose id's crc32 is divisible by ten. A null or empty text has no words and no
    run; a null id gets no planted run. Repeated rows give repeated results, an empty table an
    empty one; other columns are ignored. Texts are worked on in the task that reads them, several short ones at
    a time, and no row is shuffled.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                names = part.column(0).to_pylist() if plant else [None] * len(part)
                split = [x.encode("utf-8").split() for x in strings(part, "__text")]
                for i, (name, words) in enumerate(zip(names, split, strict=True)):
                    if put := planted(name, len(words)):
                        a, p = put
                        split[i] = words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), len(words) - a))
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                codes: dict[bytes, int] = defaultdict(itertools.count().__next__)
                words = np.fromiter(map(codes.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lengths.sum()))
                runs = find_runs(words, lengths, least, times)
                edge = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
                rows = [summary(w, runs[edge[i] : edge[i + 1], 1:]) for i, w in enumerate(split)]
                columns = [part.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(x.split(" ")[0] for x in SCHEMA.split(", "))])

    rows = spread(docs.select(F.col(id_col), F.col(text_col).alias("__text")))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
