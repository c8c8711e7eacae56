"""Substring joins by an index of short grams instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Needles up to this length are looked up as a whole.
GRAM = 8


def _grams(c: Column, size: Column) -> Column:
    """Distinct substrings of one length."""
    places = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(places, lambda i: c.substr(i, size)))).otherwise(
        F.array().cast("array<string>")
    )


def first_containing(
    needles: DataFrame, needle: str, names: DataFrame, name: str, order: str
) -> DataFrame:
    """For each needle the first row of `names` (by `order`) whose name contains it.

    Short needles equal a substring of the name: each substring of a length that some needle has
    keeps its first row, which combines before the shuffle. A name holding a longer needle
    holds all its grams, so looking under the needle's rarest gram finds every such name.
    Both sides compare in lower case. The substrings outgrow by far the size that the optimiser
    assumes for them, so none of them is broadcast.
    """
    lowered = names.select(F.lower(name).alias("__name"), F.struct(*names.columns).alias("__row"), F.col(order).alias("__o"))
    wanted = needles.select(F.col(needle).alias("__key"), F.lower(needle).alias("__n")).distinct()
    wanted = wanted.filter(F.length("__n") > 0)
    short = wanted.filter(F.length("__n") <= GRAM)
    lengths = short.agg(F.collect_set(F.length("__n")).alias("__sizes"))  # at most GRAM numbers
    substrings = F.flatten(F.transform("__sizes", lambda q: _grams(F.col("__name"), q)))
    firsts = (
        lowered.join(F.broadcast(lengths))  # one row
        .select("__row", "__o", F.explode(substrings).alias("__n"))
        .groupBy("__n")
        .agg(F.min_by("__row", "__o").alias("__hit"))
    )
    whole = short.join(firsts.hint("merge"), "__n").select("__key", "__hit")

    gram = F.lit(GRAM)
    indexed = lowered.select("__name", "__row", "__o", F.explode(_grams(F.col("__name"), gram)).alias("__g"))
    frequency = indexed.groupBy("__g").agg(F.count(F.lit(1)).alias("__df"))
    own = wanted.filter(F.length("__n") > GRAM).select("__key", "__n", F.explode(_grams(F.col("__n"), gram)).alias("__g"))
    rarest = (
        own.join(frequency.hint("merge"), "__g", "left")
        .groupBy("__key", "__n")
        .agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("d"), F.col("__g").alias("g"))).alias("m"))
        .select("__key", "__n", F.col("m.g").alias("__g"))
    )
    hits = rarest.join(indexed.hint("merge"), "__g").filter(F.col("__name").contains(F.col("__n")))
    best = whole.unionByName(hits.groupBy("__key").agg(F.min_by("__row", "__o").alias("__hit")))
    return best.select(F.col("__key").alias(needle), "__hit.*")
