"""Ranks, running totals and exact quantiles that survive a hot group.

A plain window over a group puts the group into one task. Here the rows are range
sorted over all tasks, totals run inside each sorted slice, and the small
per-slice totals give the offset of every slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estuarine.session import materialize

_SLICE = "__slice"
_POS = "__pos"


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per `keys` in `order`; make `order` unique for stable output.

    The sorted rows are written once, since their positions must not change when
    a lost task is computed again.
    """
    named = df.select("*", *[expr.alias(name) for name, expr in totals.items()])
    placed = named.sort(*[F.col(k) for k in keys], *order).withColumn(
        _POS, F.monotonically_increasing_id()
    )
    placed = materialize(placed).withColumn(_SLICE, F.shiftright(F.col(_POS), 33).cast("int"))
    names = list(totals)
    in_slice = (
        Window.partitionBy(_SLICE, *keys).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = placed.select(
        *[c for c in placed.columns if c not in names],
        *[F.sum(n).over(in_slice).alias(n) for n in names],
    )
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_SLICE, *keys)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            F.col(_SLICE).alias("__s"),
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in names],
        )
    )
    match = local[_SLICE] == offsets["__s"]
    for i, k in enumerate(keys):
        match = match & local[k].eqNullSafe(offsets[f"__k{i}"])
    joined = local.join(offsets, match, "left")
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(n) + F.col(f"__o_{n}")).alias(n) for n in names],
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """row_number per `keys` without gathering a key's rows in one task."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, name: str | None = None
) -> DataFrame:
    """First `n` rows per key. The filter on row_number lets every map task keep `n`
    rows per key before the shuffle, so a hot key costs no more than the others."""
    pos = name or "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n)
    return out if name else out.drop(pos)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their frequencies, combined before the shuffle."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of `probs`.

    Values are counted first; the two order statistics around each quantile are
    then picked by running counts, so no task sees a whole group.
    """
    counted = value_counts(df, keys, value)
    cum = running_totals(counted, keys, [F.col(value)], {"upto": F.col("freq")})
    totals = cum.groupBy(*keys).agg(F.max("upto").alias("__n"))
    if keys:
        rows = cum.join(totals, keys)
    else:
        rows = cum.join(F.broadcast(totals))  # exactly one row
    picks = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(target), F.ceil(target)
        holds = lambda i: (F.col("upto") - F.col("freq") <= i) & (i < F.col("upto"))
        a = F.max(F.when(holds(low), F.col(value).cast("double")))
        b = F.max(F.when(holds(high), F.col(value).cast("double")))
        w = F.max(target - low)
        picks.append((a + (b - a) * w).alias(name))
    return rows.groupBy(*keys).agg(*picks)
