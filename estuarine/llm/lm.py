"""Log-bilinear language model with noise-contrastive estimation, and scores of whole texts.

A token's probability is that of its class after the classes of the two tokens before it, times its
own inside the class. The most frequent words and the end are classes of their own, all other
words share classes by their last two bytes. Class after classes is the log-bilinear model: the
vectors of the two classes before, each through a matrix of its position, predict the next vector.
All training texts count: their class triples are counted by Spark, and the model is fitted to the
table of triples, whose size is bounded by the number of classes alone. Inside a class a word has
its smoothed share of the training tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import slices, starts, strings, task
from estuarine.session import materialize

END = b""  # never a word
OWN, SHARED = 47, 48
CLASSES = 1 + OWN + SHARED


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes split at exactly the six white-space bytes."""
    return text.encode().lower().split()


def shared_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % SHARED


def word_counts(texts: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, c): tokens of all texts, the end included; combined in the tasks."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text in strings(part, "text"):
                    seen.update(words(text))
                seen[END] += len(part)
                if len(seen) > limit:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Codes of words: frequent words have a number each, all others that of their class."""

    def __init__(self, head: list[tuple[bytes, int]], own: list[bytes]):
        own = {w: 1 + i for i, w in enumerate(own)}
        self.size = len(head)
        self.code = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head] + [0] * CLASSES, float)
        self.cls = np.array([0 if w == END else own.get(w) or shared_class(w) for w, _ in head] + list(range(CLASSES)), np.int64)
        self.end = self.code[END]

    def codes(self, texts: list[str], rare: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words of each text, codes of all tokens with the ends, tokens of each text."""
        split = [words(t) for t in texts]
        code, flat = self.code, []
        for ws in split:
            found = [code.get(w, -1) for w in ws]
            if -1 in found:
                for i, c in enumerate(found):
                    if c < 0:
                        w = ws[i]
                        c = rare.get(w)
                        if c is None:
                            c = rare[w] = self.size + shared_class(w)
                        found[i] = c
            flat += found
            flat.append(self.end)
        return split, np.fromiter(flat, np.int64, len(flat)), np.array([len(ws) + 1 for ws in split], np.int64)

    def triples(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each token's class with those of the two before it, as one number; texts begin after an end."""
        cls = self.cls[flat]
        one, two = np.roll(cls, 1), np.roll(cls, 2)
        first = starts(counts)[:-1]
        one[first] = two[first] = 0
        second = first[counts > 1] + 1
        two[second] = 0
        return (two * CLASSES + one) * CLASSES + cls


class LogBilinear:
    """Class after two classes, fitted by noise-contrastive estimation."""

    def __init__(self, size: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (CLASSES, size))
        self.near, self.far = (rng.normal(0, 0.1, (size, size)) for _ in range(2))
        self.bias = np.zeros(CLASSES)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.near, self.far, self.bias]

    def fit(self, triple: np.ndarray, count: np.ndarray, steps: int = 500, noise: int = 32, rate: float = 0.02) -> LogBilinear:
        """Steps over the whole table of triples, against the expectation of `noise` classes by frequency.

        Nothing is drawn: every triple weighs its count, and each class is noise by its share.
        """
        seen = np.zeros(CLASSES**3)
        np.add.at(seen, triple, count.astype(float))
        seen = seen.reshape(CLASSES**2, CLASSES)
        share = seen.sum(0) + 0.5
        share /= share.sum()
        self.bias = np.log(share)
        seen /= max(seen.sum(), 1)
        against = seen.sum(1)[:, None] * (noise * share)
        moments = [np.zeros_like(p) for p in self.parameters()]
        squares = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            # contexts in the order of triples: the class two before, then the one before
            expected = ((self.vectors @ self.far)[:, None, :] + (self.vectors @ self.near)[None, :, :]).reshape(CLASSES**2, -1)
            # how much likelier than noise a class is
            true = 1 / (1 + np.exp(np.log(noise * share) - self.bias - expected @ self.vectors.T))
            d = seen - (seen + against) * true
            d_expected = (d @ self.vectors).reshape(CLASSES, CLASSES, -1)
            by_near, by_far = d_expected.sum(0), d_expected.sum(1)
            d_near, d_far = self.vectors.T @ by_near, self.vectors.T @ by_far
            d_vectors = d.T @ expected + by_near @ self.near.T + by_far @ self.far.T
            d_bias = d.sum(0)
            speed = rate * (1 - 0.9 * step / steps)
            for p, g, m, s in zip(self.parameters(), [d_vectors, d_near, d_far, d_bias], moments, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p += speed * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of every triple, by one batched product."""
        near, far = self.vectors @ self.near, self.vectors @ self.far
        score = (far[:, None, :] + near[None, :, :]).reshape(CLASSES**2, -1) @ self.vectors.T + self.bias
        score -= score.max(1, keepdims=True)
        score -= np.log(np.exp(score).sum(1, keepdims=True))
        return (score / np.log(10)).ravel()


def _fit(triples: DataFrame) -> LogBilinear:
    """Fit in one task: its input is at most CLASSES ** 3 rows, whatever the corpus."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        model = LogBilinear().fit(table["triple"].to_numpy(), table["n"].to_numpy())
        return pd.DataFrame({"values": [np.concatenate([p.ravel() for p in model.parameters()]).tolist()]})

    rows = triples.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "values array<double>").collect()
    model = LogBilinear()
    if rows:
        flat = np.array(rows[0]["values"])
        sizes = [p.size for p in model.parameters()]
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        model.vectors, model.near, model.far, model.bias = (x.reshape(p.shape) for x, p in zip(parts, model.parameters(), strict=True))
    return model


def score(docs: DataFrame, held_out: Column, most: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Rows where `held_out` is false or null are the training texts. Words with more than a share of
    1 / `most` of the training tokens, so at most `most`, go to every task; occurrences of rarer
    words are joined to their counts, so no count is left out and no word is common in that join.

    Null or empty text: the end alone. A null id stays null, repeated rows are counted and scored
    each, other columns are ignored, an empty table gives no rows. Without training texts nothing is
    known and the base score is 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    training = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(training))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_distinct = sums["n"] or 0, sums["v"]
    head = sorted(((bytes(r["word"]), r["c"]) for r in counts.filter((F.col("c") * most >= max(n_all, 1)) | (F.length("word") == 0)).collect()), key=lambda x: (-x[1], x[0]))
    if not any(w == END for w, _ in head):  # no training texts
        head.append((END, 0))
    own = [w for w, _ in head if w != END][:OWN]
    lexicon = Lexicon(head, own)
    out_of = docs.sparkSession.sparkContext.broadcast(lexicon)

    def masses(batches):
        alone, total = {END, *own}, np.zeros((CLASSES, 2), np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in alone:
                    total[shared_class(w)] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["cls", "c", "v"])

    mass = np.zeros(CLASSES)
    for r in counts.mapInArrow(masses, "cls long, c long, v long").groupBy("cls").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        mass[r["cls"]] = r["c"] + 0.5 * (r["v"] + 1)
    mass[mass == 0] = 0.5

    def triples(batches):
        words_of, rare = out_of.value, {}
        cells = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                rare = rare if len(rare) < most else {}
                _, flat, n = words_of.codes(strings(part, "text"), rare)
                cells += np.bincount(words_of.triples(flat, n), minlength=len(cells))
        hit = np.flatnonzero(cells)
        for i in range(0, len(hit), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hit[i : i + 100_000]), pa.array(cells[hit[i : i + 100_000]])], names=["triple", "n"])

    table = training.select("text").mapInArrow(triples, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    model = _fit(table)

    def scored(batches):
        words_of, rare = out_of.value, {}
        log_p = model.log10_table()
        alone = words_of.cls <= OWN
        inside = np.where(alone, 0.0, -np.log10(mass[words_of.cls]))
        tail = np.arange(len(words_of.cls)) >= words_of.size
        log_c = np.where(tail, 0.0, np.log10(words_of.count + 0.5))
        inside = np.where(alone, 0.0, inside + log_c)
        here, made = task() << 33, 0
        for batch in batches:
            for part in slices(batch, "text"):
                rare = rare if len(rare) < most else {}
                split, flat, n = words_of.codes(strings(part, "text"), rare)
                at = starts(n)[:-1]
                got = log_p[words_of.triples(flat, n)] + inside[flat]
                rows_of = np.arange(here + made, here + made + len(n))
                made += len(n)
                none = [None] * len(n)
                base = np.add.reduceat(log_c[flat], at) if len(n) else np.zeros(0)
                known = np.add.reduceat((words_of.count[flat] > 0).astype(np.int64), at) if len(n) else np.zeros(0, np.int64)
                total = np.add.reduceat(got, at) if len(n) else np.zeros(0)
                names = ["row", "word", "f", "id", "held_out", "n_tokens", "n_known", "base", "score"]
                keys = pa.array([b" %d" % r for r in rows_of], pa.binary())  # no word has a space
                yield pa.RecordBatch.from_arrays([pa.array(rows_of), keys, pa.array(none, pa.int64()), part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(total)], names=names)
                row, word, times = [], [], []
                frequent = words_of.code
                for r, ws in zip(rows_of.tolist(), split, strict=True):
                    found = Counter([w for w in ws if w not in frequent])
                    row += [r] * len(found)
                    word += found
                    times += found.values()
                none = pa.nulls(len(row))
                kinds = (part.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64()), *(none.cast(k) for k in kinds)], names=names)

    schema = f"row long, word binary, f long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    terms = rows.select("id", "held_out", "text").mapInArrow(scored, schema).join(counts, "word", "left")
    log_c = F.col("f") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = terms.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.bool_or("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.lit(0))) + F.sum(F.when(F.col("c").isNotNull(), F.coalesce("f", F.lit(0))).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", log_c)).alias("base"),
        F.sum(F.coalesce("score", log_c)).alias("score"),
    )
    share = F.log10(F.lit(n_all + 0.5 * (n_distinct + 1)))
    # a tail word has the numerator log_c in both scores; unknown words at the head's tables have count 0
    return sums.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * share).alias("base_score"), "score")
