"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

Sharding. The hash of every 16-byte string is taken, and each window of `length` bytes belongs to
the leftmost smallest hash inside it, its anchor. Equal windows have equal anchors, so windows need
to be compared only under one anchor. Consecutive windows with one anchor are a segment; segments
whose anchor occurs once in the corpus hold no repeated window and stay behind. Where all segments of an
anchor are equal, every window of theirs repeats and they are spans as they are. Of the rest, equal
segments are folded into a weighted one and dealt to shards by anchor.

Each shard is one text, its segments between separators that no UTF-8 text contains. Its suffix array
is built by induced sorting; where neighbours have common prefixes of `length` or more, windows are
equal. Segments of an anchor with more than `split` of them are cut and dealt by the second smallest hash of their windows; where that is
as common, they are dealt to several shards and their windows also compared between shards, by 128-bit names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import ranges, slices, starts
from estuarine.llm.shingles import U, mix
from estuarine.llm.suffixes import permuted_prefixes, suffix_array
from estuarine.session import materialize

GRAM = 16
GAP = 255
#: Bytes that are hashed at once, doubled at most; every byte takes some 100 bytes of arrays.
PIECE = 1 << 18
PLACE = U((1 << 24) - 1)


class Anchors:
    """Segments of texts: runs of windows with one anchor."""

    def __init__(self, length: int, seed: int = 20_231_101):
        rng = np.random.default_rng(seed)
        self.length = length
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        base = int(rng.integers(1 << 62)) * 2 + 1
        size = 3 * PIECE + 4 * length
        self.power, self.back = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        for x in (self.power, self.back):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def segments(self, texts: list[bytes], second: bool = False) -> tuple[np.ndarray, ...]:
        """(text, start, bytes, anchor, name) of all segments of some texts; with `second` of segments, by the smallest hash but their anchor's."""
        found, held, size = [], [], 0
        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            for a in range(0, len(t) - self.length + 1, PIECE):  # windows that start in a..a+PIECE
                part = t[a : a + PIECE + self.length - 1]
                if size + len(part) > 2 * PIECE:
                    found.append(self._block(held, second))
                    held, size = [], 0
                held.append((i, a, part))
                size += len(part)
        if held:
            found.append(self._block(held, second))
        if not found:
            return (*(np.zeros(0, np.int64) for _ in range(5)),)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _smallest(self, keys: np.ndarray, windows: int) -> np.ndarray:
        """Place of each window's smallest key."""
        width = self.length - GRAM + 1
        full = -(-len(keys) // width) * width
        grid = np.full(full + width, np.iinfo(np.uint64).max, U)
        grid[: len(keys)] = keys
        grid = grid.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        best = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        return (best & PLACE).astype(np.int64)

    def _block(self, parts: list[tuple[int, int, bytes]], second: bool = False) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(p) for _, _, p in parts])
        text = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        n = len(text)
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.letters[text] * self.power[:n], dtype=U)])
        grams = mix((total[GRAM:] - total[: n - GRAM + 1]) * self.back[: n - GRAM + 1])
        # hash above, place below: the minimum is the leftmost of the smallest
        keys = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
        windows = n - self.length + 1
        anchor = self._smallest(keys, windows)
        bounds = starts(lengths)
        if second:
            keys[anchor[bounds[:-1]]] = np.iinfo(np.uint64).max
            anchor = self._smallest(keys, windows)
        inside = np.zeros(windows, np.int64)  # windows don't run over the end of their text
        fit = np.maximum(lengths - self.length + 1, 0)
        inside[ranges(bounds[:-1], fit)] = np.repeat(np.arange(1, len(parts) + 1), fit)
        run = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(inside, prepend=0) != 0))
        stop = np.append(run[1:], windows)
        ok = inside[run] > 0
        run, stop = run[ok], stop[ok]
        part = inside[run] - 1
        end = stop - 1 + self.length
        names = mix((total[end] - total[run]) * self.back[run] + (end - run).astype(U))
        origin = np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts])
        return origin[0][part], origin[1][part] + run - bounds[part], end - run, mix(grams[anchor[run]]).view(np.int64), names.view(np.int64)


def _bytes(batch: pa.RecordBatch, i: int) -> list[bytes]:
    column = batch.column(i)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _occurrences(texts: DataFrame, length: int, names_only: bool) -> DataFrame:
    """Segments of (key, text) rows; with `names_only` just anchors with their numbers, the smallest name and whether all names are it."""

    def run(batches):
        finder = Anchors(length)
        for batch in batches:
            for part in slices(batch, "text"):
                which, start, size, anchor, name = finder.segments(_bytes(part, 1))
                if names_only:
                    if not len(anchor):
                        continue
                    order = np.argsort(anchor, kind="stable")
                    anchor, name = anchor[order], name[order]
                    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                    low, high = np.minimum.reduceat(name, head), np.maximum.reduceat(name, head)
                    columns = anchor[head], np.diff(head, append=len(anchor)), low, low == high
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor", "n", "name", "same"])
                else:
                    keys = part.column(0).take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(size.astype(np.int32)), pa.array(anchor), pa.array(name)], names=["key", "start", "size", "anchor", "name"])

    return texts.mapInArrow(run, "anchor long, n long, name long, same boolean" if names_only else f"key {texts.schema['key'].dataType.simpleString()}, start long, size int, anchor long, name long")


def _cut(rows: DataFrame) -> DataFrame:
    """Bytes of segments from (text, parts), parts being (start, size, anchor, name, weight, salt)."""

    def run(batches):
        for batch in (part for b in batches for part in slices(b, "text")):
            out = [[], [], [], [], []]
            for text, parts in zip(_bytes(batch, 0), batch.column(1).to_pylist(), strict=True):
                for p in parts:
                    for to, v in zip(out, (p["anchor"], p["name"], p["weight"], p["salt"], text[p["start"] : p["start"] + p["size"]]), strict=True):
                        to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["anchor", "name", "weight", "salt", "bytes"])

    return rows.mapInArrow(run, "anchor long, name long, weight long, salt long, bytes binary")


def _refine(segments: DataFrame, length: int) -> DataFrame:
    """Segments cut where the second smallest hash of their windows changes, which is their `salt` then.

    Equal windows of one anchor have equal second hashes, too.
    """

    def run(batches):
        finder = Anchors(length)
        for batch in (part for b in batches for part in slices(b, "bytes")):
            texts = _bytes(batch, batch.schema.get_field_index("bytes"))
            which, start, size, second, _ = finder.segments(texts, True)
            keys = [batch.column(c).take(pa.array(which)) for c in ("anchor", "name", "weight")]
            parts = [texts[i][a : a + n] for i, a, n in zip(which.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(second, pa.int64()), pa.array(parts, pa.binary()), pa.array(start, pa.int64())], names=["anchor", "name", "weight", "salt", "bytes", "offset"])

    return segments.mapInArrow(run, "anchor long, name long, weight long, salt long, bytes binary, offset long")


def _compare(segments: DataFrame, length: int, block: int) -> DataFrame:
    """Segments with the windows that repeat within their shard, as `runs` of window starts, one row for each segment that has any.

    Where `named` segments are dealt to several shards, `heads` has each distinct window in the segment where it
    stands first: its place, name and number.
    """

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    head = pa.struct([("begin", pa.int64()), ("window", pa.binary()), ("total", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.list_(head))

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[4]) for r in rows])
        text = np.frombuffer(bytes([GAP]).join(r[4] for r in rows) + bytes([GAP]), np.uint8)
        at = starts(sizes + 1)
        suffixes = suffix_array(text)
        fresh = np.zeros(len(text), bool)
        fresh[at[:-1]] = True
        prefix = permuted_prefixes(text, suffixes, fresh, 2 * length + 64)
        of = np.repeat(np.arange(len(rows)), sizes + 1)
        inside = np.arange(len(text)) + length < at[of + 1]  # the window ends before the separator
        order = suffixes[inside[suffixes]]
        # neighbours in the array that are both windows stay neighbours: equal windows lie together
        group = np.cumsum(prefix[order] < length) - 1
        weight = np.array([r[2] for r in rows])
        total = np.bincount(group, weights=weight[of[order]]).astype(np.int64)
        repeated = np.zeros(len(text), bool)
        repeated[order] = total[group] > 1
        edge = np.diff(np.concatenate([[False], repeated & inside, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        runs: dict[int, list[dict]] = {}
        row = of[begin]
        for i, a, b in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
            runs.setdefault(i, []).append({"begin": a + rows[i][5], "end": b + rows[i][5]})
        windows: dict[int, list[dict]] = {}
        heads = np.flatnonzero(np.diff(group, prepend=-1)) if any(r[6] for r in rows) else ()
        data = text.tobytes() if len(heads) else b""
        for h in heads:
            p = int(order[h])
            i = int(of[p])
            if rows[i][6]:
                name = hashlib.blake2b(data[p : p + length], digest_size=16).digest()
                windows.setdefault(i, []).append({"begin": p - int(at[i]) + rows[i][5], "window": name, "total": int(total[group[h]])})
        out = [(rows[i][0], rows[i][1], runs.get(i), windows.get(i)) for i in sorted(runs.keys() | windows.keys())]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "name", "runs", "heads"])

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > block and (r[0], r[3]) != (rows[-1][0], rows[-1][3]):
                    yield shard(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
        if rows:
            yield shard(rows)

    dealt = segments.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.select("anchor", "name", "weight", "salt", "bytes", "offset", "named").mapInArrow(run, "anchor long, name long, runs array<struct<begin: long, end: long>>, heads array<struct<begin: long, window: binary, total: long>>")


def repeated_spans(texts: DataFrame, length: int = 200, split: int = 4096, block: int = 1 << 20) -> DataFrame:
    """(key, spans) for the texts of (key, text) that hold repeated strings.

    Spans are (begin, end) bytes to remove, sorted, not touching.
    """
    # both tables that the places are joined to are written first, so that Spark can split a common anchor's rows
    alike = F.bool_and("same") & (F.min("name") == F.max("name"))
    shared = materialize(_occurrences(texts, length, True).groupBy("anchor").agg(F.sum("n").alias("n"), alike.alias("alike")).filter("n > 1").select("anchor", "alike"))
    places = materialize(_occurrences(texts, length, False).join(shared, "anchor"))
    classes = places.filter("not alike").groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("key", "start", "size")).alias("at"))
    classes = materialize(classes.select("anchor", "name", "weight", "at.*"))
    # anchors with many different segments have 0 for salt, the others -1
    large = materialize(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split).select("anchor", F.lit(0).cast("long").alias("big")))
    salt = F.coalesce("big", F.lit(-1).cast("long")).alias("salt")
    chosen = classes.join(large, "anchor", "left").select("key", F.struct("start", "size", "anchor", "name", "weight", salt).alias("part"))
    asked = chosen.groupBy("key").agg(F.collect_list("part").alias("parts"))  # at most one text's segments
    segments = _cut(texts.join(asked, "key").select("text", "parts")).withColumns({"offset": F.lit(0).cast("long"), "named": F.lit(False)})
    if not large.isEmpty():
        # equal windows of these share a second hash, so they are dealt by it; one that is still too common goes to several shards
        segments = materialize(segments)
        fine = segments.filter("salt >= 0")
        fine = materialize(_refine(fine, length) if length > GRAM else fine.drop("named"))
        counts = fine.groupBy("anchor", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")).filter("total > 1")
        named, shard = F.col("n") > split, F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / split))
        dealt = F.when(named, F.xxhash64("salt", shard)).otherwise(F.col("salt"))
        fine = fine.join(counts, ["anchor", "salt"]).withColumns({"salt": dealt, "named": named}).select(segments.columns)
        segments = segments.filter("salt < 0").unionByName(fine)
    found = materialize(_compare(segments, length, block))

    spans = found.filter("runs is not null").select("anchor", "name", "runs")
    named = found.filter("heads is not null").select("anchor", "name", F.inline("heads"))
    if not named.isEmpty():
        # windows of one shard are one row by now; those that other shards have too
        often = named.groupBy("window").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("shards")).filter("shards > 1").select("window")
        more = named.join(often, "window", "left_semi").groupBy("anchor", "name").agg(F.collect_list(F.struct("begin", (F.col("begin") + 1).alias("end"))).alias("runs"))
        spans = materialize(spans.unionByName(more))
    hit = places.filter("not alike").join(spans, ["anchor", "name"]).select("key", "start", F.explode("runs").alias("r"))
    hit = hit.select("key", (F.col("start") + F.col("r.begin")).alias("begin"), (F.col("start") + F.col("r.end") - 1 + length).alias("end"))
    whole = places.filter("alike").select("key", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))
    return hit.unionByName(whole).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def union_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedupe(docs: DataFrame, length: int = 200, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`; with `with_text` also
    the remaining text, without the halves of characters that were cut in two.

    Every byte covered by a string of `length` bytes that starts anywhere else as well, in this or
    another row, goes. Null text: 0 bytes. Texts shorter than `length` keep everything. Repeated
    rows count as separate texts, so they lose all they share, and so do different texts under one id
    or without id, which are told apart by a hash of the text. Only the id and the columns in `keep` are returned; an empty table gives no rows.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    rows = docs.select(F.col(id_col), *map(F.col, keep), key.alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    spans = repeated_spans(rows.select(F.col("__key").alias("key"), F.col("__text").alias("text")), length).toDF("__span_key", "__spans")

    def run(batches):
        for batch in (part for b in batches for part in slices(b, "__text")):
            texts, n = _bytes(batch, batch.num_columns - 2), batch.num_columns - 2
            cols = [[], [], [], [], []]
            for text, found in zip(texts, batch.column(n + 1).to_pylist(), strict=True):
                cuts = union_spans(found or [])
                left, at = [], 0
                for a, b in cuts:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                rest = b"".join(left)
                for to, v in zip(cols, (len(text), len(text) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if with_text else None), strict=True):
                    to.append(v)
            out = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out[: 4 + with_text]], names=[*batch.schema.names[:n], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: n + 4 + with_text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: 1 + len(keep)])
    joined = rows.join(spans, F.col("__key") == F.col("__span_key"), "left").select(id_col, *keep, "__text", "__spans")
    return joined.mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
