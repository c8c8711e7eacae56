"""Adapters in reads with a share of errors, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

BLOCK = 4_000_000


def _starts(text: np.ndarray, adapter: np.ndarray) -> np.ndarray:
    """Least edit distance of the adapter to the stretches of `text` that start at every place.

    Both are read backwards, so the end of a stretch is free. A row of the distance table is
    one vector for all reads; steps along the text are a running minimum.
    """
    at = np.arange(len(text) + 1, dtype=np.int32)
    text = text[::-1]
    row = np.zeros(len(text) + 1, np.int32)
    for i, base in enumerate(adapter[::-1], 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != base), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - at) + at
    return row[:0:-1]


def _endings(tails: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """(reads, w): edit distance of the prefix to the last w bases of every read."""
    wide = tails.shape[1]
    back = tails[:, ::-1]
    row = [np.full(len(tails), w, np.int32) for w in range(wide + 1)]
    for i, base in enumerate(prefix[::-1], 1):
        new = [np.full(len(tails), i, np.int32)]
        for w in range(1, wide + 1):
            new.append(np.minimum(np.minimum(row[w], new[w - 1]) + 1, row[w - 1] + (back[:, w - 1] != base)))
        row = new
    return np.stack(row, axis=1)


def adapter_starts(seqs: list[str], adapters: list[str], error_rate: float, min_overlap: int) -> np.ndarray:
    """Where the best adapter match of every read begins; the read's length without one.

    A match is a whole adapter anywhere, or its first L bases (`min_overlap` or more) as the read's end, with at
    most `error_rate` * L edits. The best one has the largest L - 2 * edits, ties to the earliest start.
    """
    raw = [s.encode() for s in seqs]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    best, start = np.full(len(raw), -1, np.int64), size.copy()

    def offer(reads: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        order = np.lexsort((at, -score, reads))
        reads, score, at = reads[order], score[order], at[order]
        first = np.flatnonzero(np.diff(reads, prepend=-1))
        reads, score, at = reads[first], score[first], at[first]
        better = (score > best[reads]) | ((score == best[reads]) & (at < start[reads]))
        best[reads[better]], start[reads[better]] = score[better], at[better]

    most = max(int(len(a) * error_rate) for a in adapters)
    gap = b"\0" * (most + 1)  # no match with so few errors reaches over it
    text = np.frombuffer(gap.join([*raw, b""]), np.uint8)
    begin = np.concatenate(([0], np.cumsum(size + len(gap))))[:-1]
    for adapter in adapters:
        codes, m = np.frombuffer(adapter.encode(), np.uint8), len(adapter)
        for a in range(0, len(text), BLOCK):
            part = text[a : a + BLOCK + m + most]
            found = _starts(part, codes)[: min(BLOCK, len(part))]
            places = np.flatnonzero(found <= int(m * error_rate))
            reads = np.searchsorted(begin, places + a, "right") - 1
            inside = places + a - begin[reads] < size[reads]
            reads, places = reads[inside], places[inside]
            offer(reads, m - 2 * found[places].astype(np.int64), places + a - begin[reads])
        wide = m - 1 + most
        tails = np.zeros((len(raw), wide), np.uint8)
        for i, r in enumerate(raw):
            end = r[-wide:]
            tails[i, wide - len(end) :] = np.frombuffer(end, np.uint8)
        for n in range(min_overlap, m):
            errors = int(n * error_rate)
            if errors:
                distance = _endings(tails[:, wide - n - errors :], codes[:n])
                distance[:, : n - errors] = n
            else:
                same = (tails[:, wide - n :] == codes[:n]).all(1)
                distance = np.full((len(raw), n + 1), n)
                distance[:, n] = np.where(same, 0, n)
            distance[np.arange(distance.shape[1])[None] > size[:, None]] = n
            reads, w = np.nonzero(distance <= errors)
            offer(reads, n - 2 * distance[reads, w].astype(np.int64), size[reads] - w)
    return start


def without_adapters(seq: Column, adapters: list[str], error_rate: float, min_overlap: int, passes: int) -> Column:
    """Length of a read that is left after `passes` removals of the best match and all that follows it."""

    @pandas_udf("int")
    def kept(batch: pd.Series) -> pd.Series:
        fine = batch.notna().to_numpy()
        texts = batch[fine].tolist()
        out = np.fromiter(map(len, texts), np.int64, len(texts))
        todo = np.arange(len(texts))
        for _ in range(passes):
            if not len(todo):
                break
            left = adapter_starts([texts[i][: out[i]] for i in todo], adapters, error_rate, min_overlap)
            shorter = left < out[todo]
            out[todo] = left
            todo = todo[shorter]
        result = pd.Series(np.full(len(batch), None), dtype="Int32")
        result[fine] = out
        return result

    return kept(seq)
