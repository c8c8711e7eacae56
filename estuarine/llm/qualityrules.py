"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted, one
over the trusted documents and one over the whole raw corpus; a document's verdict is the mean
log ratio of its n-grams, so its length doesn't matter, held against a fixed threshold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import SPACE

#: The symbols and the window of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once per row, wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(h: Column) -> Column:
    """Hash of each word with the next one."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda x, y: F.xxhash64(x, y))


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs."""
    n = F.lit(buckets).cast("long")
    return F.transform(let(h, lambda x: F.concat(x, _pairs(x))), lambda x: F.pmod(x, n).cast("int"))


def _hashes(text: Column) -> Column:
    """Hashes of a text's words in order."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))


def _counts(texts: Column, docs: DataFrame, buckets: int, name: str) -> DataFrame:
    return docs.select(F.explode(_grams(_hashes(texts), buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, prior: float, id_col: str, text_col: str) -> list[float]:
    """Log ratio of each bucket's probability, target to raw.

    The raw multinomial has one count more per bucket; the target multinomial is smoothed towards
    the raw one with a weight of `prior` counts per bucket, so a bucket that the target never
    shows and the raw corpus hardly shows says little. The list has `buckets` numbers.
    """
    # the trusted ids grow with the corpus: they are never broadcast, whatever their size here
    ids = trusted.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct()
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(ids.hint("merge"), "__id", "left_semi")
    raw = _counts(F.col(text_col), docs, buckets, "raw")
    target = _counts(F.col("__text"), chosen, buckets, "target")
    both = raw.join(target, "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target"))
    rows = both.collect()  # at most one row per bucket
    n_raw, n_target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    out = [0.0] * buckets
    if not n_target:
        return out
    weight = prior * buckets
    for r in rows:
        p = (r["raw"] + 1) / (n_raw + buckets)
        out[r["bucket"]] = math.log((r["target"] + weight * p) / (n_target + weight) / p)
    return out


def _windows(h: Column) -> Column:
    """Hash of the words of every window, from hashes of its pairs."""
    n = F.greatest(F.size(h) - WINDOW + 1, F.lit(0))
    return let(_pairs(h), lambda p: F.zip_with(F.zip_with(F.slice(p, 1, n), F.slice(p, 3, n), lambda x, y: F.xxhash64(x, y)), F.slice(h, WINDOW, n), lambda x, y: F.xxhash64(x, y)))


def _repeated_words(h: Column) -> Column:
    """Words in windows that the text has twice or more; nothing is sorted where none repeats."""

    def twice(order: Column) -> Column:
        """Places of the windows that equal a neighbour in the sorted windows."""
        near = lambda p, k: F.get(order, k)["x"].eqNullSafe(p["x"])
        return F.array_sort(F.transform(F.filter(order, lambda p, k: near(p, k + 1) | ((k > 0) & near(p, k - 1))), lambda p: p["i"]))

    def covered(t: Column) -> Column:
        """A repeated window covers its words up to where the next one begins."""
        steps = F.transform(t, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(t, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(order, twice), covered)).otherwise(0)

    return let(_windows(h), count)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = -0.08,
    buckets: int = 16_384,
    prior: float = 1.0,
    keep: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base counts, `base_failed`, the mean log ratio `llr` and the verdict `kept` of every row.

    `trusted` names the documents of the target corpus by `id_col`; the raw corpus is all of
    `docs`. A document is kept if it passes the base rules and its mean log ratio is at least
    `threshold`; there is no random draw. The only shuffles are those of bucket counts, combined
    in the map tasks, and of the trusted documents' join; the driver gets one number per bucket.

    Null or empty text: no words, fails the base rules. Ids that are null are never trusted.
    Repeated rows are judged each and count each in the raw corpus. Without trusted documents all
    ratios are 0 and the base rules decide. Only the id, the text and the columns named in `keep`
    are returned; an empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted, buckets, prior, id_col, text_col)
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)

    def measured(h: Column) -> Column:
        total = F.aggregate(_grams(h, buckets), F.lit(0.0), lambda a, b: a + F.get(model, b))
        mean = total / F.greatest(2 * F.size(h) - 1, F.lit(1))
        return F.struct(F.size(h).cast("long").alias("words"), _repeated_words(h).cast("long").alias("repeats"), mean.alias("llr"))

    m = F.col("__m")
    failed = (m["words"] < 10) | (100 * m["repeats"] > 20 * m["words"])
    rows = docs.select(id_col, *keep, text.alias("__text"), let(_hashes(text), measured).alias("__m"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("__lines"))
    return rows.select(
        id_col,
        *keep,
        m["words"].alias("n_words"),
        F.length(F.regexp_replace("__text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("__lines").cast("long").alias("n_dup_lines"),
        m["repeats"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (m["llr"] >= threshold)).alias("kept"),
        m["llr"].alias("llr"),
    )
