"""Mixture-controlled packing of token streams into windows.

Deficit round-robin: every source is a queue, each window adds a quantum of its length times the
source's target share to the source's deficit, and the queue with the largest claim is served
next. Served token by token, token k of a source with share p falls due at time (k + 1/2) / p, so
the tokens that the first w windows take are the w * length that fall due first. That gives the
deficits carried into any window in closed form: a task works out the state before its own
windows from the queues' totals alone, whatever partitions came before, and a queue that runs dry
leaves its share to the others in proportion.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import slices, starts, strings, task
from estuarine.llm.wordbpe import WordPieces
from estuarine.operators.ordered import running_totals
from estuarine.session import materialize


class Mixture:
    """Which token of which queue lies where, from the queues' totals and target shares."""

    def __init__(self, totals: list[int], shares: list[float], window: int):
        self.totals = np.asarray(totals, np.int64)
        self.shares = np.asarray(shares, float)
        self.window, self.all = window, int(self.totals.sum())
        self.full, rest = divmod(self.all, window)
        # the last, short window is cut into powers of two, which need no padding
        parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.last = starts(np.asarray(parts, np.int64))

    def due(self, times: np.ndarray) -> np.ndarray:
        """Tokens of each queue due by each time."""
        return np.minimum(self.totals, np.floor(times[:, None] * self.shares + 0.5).astype(np.int64))

    def taken(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each window; the rows sum to the windows' starts."""
        goal = np.minimum(windows * self.window, self.all)
        low, high = np.zeros(len(goal)), np.full(len(goal), float(np.max((self.totals + 1) / self.shares)))
        for _ in range(80):
            middle = (low + high) / 2
            below = self.due(middle).sum(1) <= goal
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        out = self.due(low)
        short = goal - out.sum(1)
        for i in np.flatnonzero(short):  # tokens due at one moment: served in the queues' order
            while short[i] > 0:
                after = np.where(out[i] < self.totals, (out[i] + 0.5) / self.shares, np.inf)
                out[i, np.argmin(after)] += 1
                short[i] -= 1
        return out

    def pieces(self, queue: int, start: int, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts of one stretch of a queue: begin and end in the queue, sequence, offset there.

        `edges`: where the stretch's documents begin, and its end, counted from `start`.
        """
        first, last = start, start + int(edges[-1])
        at = self.due(np.array([(first + 0.5), (last + 0.5)]) / self.shares[queue]).sum(1) // self.window
        windows = np.arange(max(int(at[0]) - 2, 0), min(int(at[1]) + 2, self.full) + 2)
        before = self.taken(windows)
        own, ahead = before[:, queue], np.diff(before[:, :queue].sum(1)) if queue else np.zeros(len(windows) - 1, np.int64)
        cuts = [start + edges, own]
        if windows[-2] == self.full:
            cuts.append(own[-2] - ahead[-1] + self.last)
        cuts = np.unique(np.concatenate(cuts))
        cuts = cuts[(cuts >= first) & (cuts <= last)]
        begin, end = cuts[:-1], cuts[1:]
        k = np.searchsorted(own, begin, "right") - 1
        k = np.minimum(k, len(windows) - 2)
        offset, sequence = begin - own[k] + ahead[k], windows[k]
        tail = sequence == self.full
        if tail.any():
            part = np.searchsorted(self.last, offset[tail], "right") - 1
            offset[tail] -= self.last[part]
            sequence[tail] += part
        return begin, end, sequence, offset


def pack(
    docs: DataFrame,
    path: str,
    window: int = 4096,
    end_id: int = 2,
    targets: dict[str, float] | None = None,
    chunk: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    Each document is its ids and `end_id`. Every window of `window` tokens is filled from the
    sources in their target shares; by default these are the sources' shares of all tokens, so
    that every window has the mixture of the whole. The short last window is cut into powers of
    two. A source without a target shares a hundredth of the smallest target.

    Documents are tokenized once, into chunks of one source that are written to the shared folder;
    positions in the queues are running totals over chunks. A hot source is only more chunks. The
    driver holds one number per source.

    Null text: the end id alone. Null source: the queue named by the empty string. A null id stays
    null, repeated rows are packed each, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession

    def chunked(batches):
        pieces, here, made = WordPieces(path), task(), 0
        wide = np.dtype("<u2") if max(pieces.tokenizer.get_vocab_size(), end_id) < 65_536 else np.dtype("<u4")
        queues: dict[str, list] = {}
        held = 0

        def out(names):
            nonlocal made, held
            cols = {k: [] for k in ("source", "seq", "n", "ids", "lens", "tokens")}
            for name in names:
                ids, lens, parts = queues.pop(name)
                data = np.concatenate(parts).astype(wide)
                held -= len(data)
                for k, v in zip(cols, (name, made, len(data), ids, lens, data.tobytes()), strict=True):
                    cols[k].append(v)
                made += 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([here] * len(cols["n"]), pa.int64()), *(pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))], names=["part", *cols]
            )

        for batch in batches:
            for some in slices(batch, "__text"):
                flat, counts = pieces.ids(strings(some, "__text"))
                at = starts(counts).tolist()
                for i, (doc, name) in enumerate(zip(some.column(0).to_pylist(), strings(some, "__source"), strict=True)):
                    ids, lens, parts = queues.setdefault(name, [[], [], []])
                    ids.append(doc)
                    lens.append(at[i + 1] - at[i] + 1)
                    parts += [flat[at[i] : at[i + 1]], np.array([end_id], np.uint32)]
                    held += lens[-1]
                    if len(lens) % 16 == 0 and sum(lens) >= chunk:
                        yield out([name])
                if held > 32 * chunk:
                    yield out(list(queues))
        if queues:
            yield out(list(queues))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).cast("string").alias("__source"))
    chunks = materialize(rows.mapInArrow(chunked, "part long, source string, seq long, n long, ids array<long>, lens array<long>, tokens binary"))
    sizes = chunks.select("source", "part", "seq", "n")
    totals = sorted((r["source"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect())
    names = [k for k, _ in totals]
    shares = [float(v) for _, v in totals]
    if targets:
        least = min(v for v in targets.values() if v > 0) / 100
        shares = [targets.get(k) or least for k in names]
    shares = [v / sum(shares) for v in shares]
    mixture = Mixture([v for _, v in totals], shares, window)
    index = {k: i for i, k in enumerate(names)}
    begun = running_totals(sizes, ["source"], [F.col("part"), F.col("seq")], {"__end": F.col("n")})
    begun = begun.select("part", "seq", (F.col("__end") - F.col("n")).alias("begin"))

    def placed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.asarray(row["lens"], np.int64)
                edges = starts(lens)
                wide = np.dtype("<u2") if len(row["tokens"]) == 2 * edges[-1] else np.dtype("<u4")
                data = memoryview(np.frombuffer(row["tokens"], wide).astype("<u4").tobytes())
                begin, end, sequence, offset = mixture.pieces(index[row["source"]], row["begin"], edges)
                a, b = begin - row["begin"], end - row["begin"]
                doc = np.searchsorted(edges, a, "right") - 1
                sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                ids = pa.array(row["ids"], pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(a - edges[doc]), pa.array(b - a), pa.array(sums, pa.int64()), pa.array(lens[doc]), pa.array(sequence), pa.array(offset), pa.array([row["source"]] * len(a), pa.string())],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", source_col],
                )

    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, `{source_col}` string"
    return chunks.join(begun, ["part", "seq"]).select("source", "begin", "ids", "lens", "tokens").mapInArrow(placed, schema)
