"""Local alignment of search hits: seeds choose a diagonal, banded dynamic programming the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estuarine.operators.kmersearch import kmer_search

# Twice the scores of a fast nucleotide search (1, -2, -2.5), and their Karlin-Altschul parameters.
MATCH, MISMATCH, GAP = 2, -4, 5
LAMBDA, KAPPA = 1.28, 0.46
#: Bytes of the table of steps that a task holds at a time, for all pairs of a block together.
TABLE = 64_000_000

SCORES = (
    "score long, identity double, align_length long, matches long, mismatches long, gaps long, "
    "q_start long, q_end long, s_start long, s_end long"
)


def codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode(), np.uint8)


def diagonal(query: np.ndarray, ref: np.ndarray, k: int, width: int) -> int:
    """Reference minus query place of the band's middle: the `width` diagonals with the most shared words of k bases."""

    def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x) - k + 1
        value = np.zeros(max(n, 0), np.uint64)
        for i in range(k if n > 0 else 0):
            value = value * np.uint64(1_000_003) + x[i : i + n]
        return np.unique(value, return_index=True)

    (a, at), (b, bt) = words(query), words(ref)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0
    d = np.sort(bt[j] - at[i])
    inside = np.searchsorted(d, d + width, "right") - np.arange(len(d))
    first = int(inside.argmax())
    return int(d[first + (inside[first] - 1) // 2])


def align(pairs: list[tuple[np.ndarray, np.ndarray]], k: int = 8, band: int = 64) -> np.ndarray:
    """Best local alignments as rows of SCORES without identity, all pairs side by side.

    A row of the table is one query base of every pair, over the `band` diagonals around that of the pair's seeds. Steps along
    the reference are a running maximum. Of equal scores the alignment that ends first counts; on the way back bases are paired
    rather than skipped.
    """
    n = len(pairs)
    q_len, r_len = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    offset = np.array([diagonal(q, r, k, band // 2) for q, r in pairs]) - band // 2
    rows = int(q_len.max(initial=0))
    query = np.zeros((n, rows), np.uint8)
    ref = np.full((n, int(r_len.max(initial=0))), 1, np.uint8)
    for i, (q, r) in enumerate(pairs):
        query[i, : len(q)], ref[i, : len(r)] = q, r
    steps = np.zeros((rows, n, band), np.uint8)
    slope = GAP * np.arange(band, dtype=np.int32)
    score = np.zeros((n, band), np.int32)
    best, end_q, end_t = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        place = i + offset[:, None] + np.arange(band)[None]
        inside = (place >= 0) & (place < r_len[:, None]) & (i < q_len)[:, None]
        same = np.take_along_axis(ref, np.clip(place, 0, ref.shape[1] - 1), 1) == query[:, i : i + 1]
        paired = score + np.where(same, MATCH, MISMATCH)
        skipped = np.full_like(score, -GAP)
        skipped[:, :-1] = score[:, 1:] - GAP
        top = np.where(inside, np.maximum(np.maximum(paired, skipped), 0), 0)
        score = np.maximum.accumulate(top + slope, axis=1) - slope
        score[~inside] = 0
        steps[i] = np.where(score <= 0, 0, np.where(score > top, 3, np.where(paired == score, 1, 2)))
        high = score.max(1)
        better = high > best
        best = np.where(better, high, best)
        end_q = np.where(better, i, end_q)
        end_t = np.where(better, score.argmax(1), end_t)
    at, t, every = end_q.copy(), end_t.copy(), np.arange(n)
    matches, mismatches, gaps = (np.zeros(n, np.int64) for _ in range(3))
    going = best > 0
    first_q, first_r = at.copy(), at + offset + t
    while going.any():
        step = np.where(going, steps[np.maximum(at, 0), every, t], 0)
        step[at < 0] = 0
        going = step > 0
        place = at + offset + t
        first_q, first_r = np.where(going & (step != 3), at, first_q), np.where(going & (step != 2), place, first_r)
        same = going & (step == 1) & (query[every, np.maximum(at, 0)] == ref[every, np.clip(place, 0, ref.shape[1] - 1)])
        matches += same
        mismatches += going & (step == 1) & ~same
        gaps += step >= 2
        at = at - np.isin(step, (1, 2))
        t = np.clip(t + (step == 2) - (step == 3), 0, band - 1)
    found = best > 0
    spans = [np.where(found, x + 1, 0) for x in (first_q, end_q, first_r, end_q + offset + end_t)]
    return np.stack([best, matches + mismatches + gaps, matches, mismatches, gaps, *spans], axis=1)


def _blocks(sizes: np.ndarray, band: int) -> Iterator[np.ndarray]:
    """Rows by size, cut where the table of steps would be too large."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * int(sizes[order[i]]) * band > TABLE:
            yield order[start:i]
            start = i


def align_pairs(pairs: DataFrame, k: int = 8, band: int = 64) -> DataFrame:
    """`pairs` (query_id, ref_id, q_seq, s_seq) with SCORES; places count from 1, `identity` is in percent of the alignment."""

    def run(batches):
        for batch in batches:
            q, s = ([codes(x or "") for x in batch.column(c).to_pylist()] for c in ("q_seq", "s_seq"))
            out = np.zeros((len(batch), 9), np.int64)
            for rows in _blocks(np.fromiter(map(len, q), np.int64, len(q)), band):
                out[rows] = align([(q[i], s[i]) for i in rows], k, band)
            share = np.round(100 * out[:, 2] / np.maximum(out[:, 1], 1), 9)
            columns = [batch.column("query_id"), batch.column("ref_id"), pa.array(out[:, 0]), pa.array(share), *(pa.array(out[:, i]) for i in range(1, 9))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "ref_id", *(x.split(" ")[0] for x in SCORES.split(", "))])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "ref_id")}
    rows = pairs.select("query_id", "ref_id", "q_seq", "s_seq")
    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, {SCORES}")


def aligned_hits(
    queries: DataFrame,
    refs: DataFrame,
    k: int = 8,
    top: int = 5,
    min_share: float = 0.3,
    max_evalue: float = 1e-5,
    band: int = 64,
    title: Column | None = None,
    key: str = "sequence_id",
) -> DataFrame:
    """Alignments of every query with the references that share most of its k-mers, best first (`pos` from 0).

    A hit has the scores of `align_pairs`, query_length, the query's coverage in percent, bit score and expectation in a search of all references,
    and `subject_id` and `title` as the hit tables of other programs, so the assignment operators take it
    as it is. Equal references and equal queries are aligned once.
    """
    found = kmer_search(queries, refs, k, top, min_share, key)
    q = queries.select(F.col(key).alias("query_id"), F.col("seq").alias("q_seq"))
    s = refs.select(F.col(key).alias("ref_id"), F.col("seq").alias("s_seq"), (title if title is not None else F.col(key).cast("string")).alias("title"))
    bases = refs.agg(F.sum(F.length("seq"))).first()[0] or 0
    met = found.select("query_id", "ref_id").join(q, "query_id").join(s.drop("title"), "ref_id")
    texts = met.groupBy("q_seq", "s_seq").agg(F.min(F.struct("query_id", "ref_id")).alias("first"))
    named = texts.select("first.query_id", "first.ref_id", "q_seq", "s_seq")
    scored = align_pairs(named, k, band).join(named, ["query_id", "ref_id"]).drop("query_id", "ref_id")
    hits = met.join(scored, ["q_seq", "s_seq"]).join(s.select("ref_id", "title"), "ref_id")
    raw = F.col("score") / MATCH * LAMBDA
    hits = hits.select(
        "query_id", "ref_id", F.col("ref_id").cast("string").alias("subject_id"), "title", *(x.split(" ")[0] for x in SCORES.split(", ")),
        F.length("q_seq").cast("long").alias("query_length"), (100 * (F.col("q_end") - F.col("q_start") + 1) / F.length("q_seq")).alias("coverage"),
        ((raw - float(np.log(KAPPA))) / float(np.log(2))).alias("bit_score"), (KAPPA * bases * F.length("q_seq") * F.exp(-raw)).alias("evalue"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("identity"), "ref_id")
    good = hits.filter((F.col("score") > 0) & (F.col("evalue") <= max_evalue))
    return good.withColumn("pos", (F.row_number().over(best) - 1).cast("long"))
