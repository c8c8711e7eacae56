"""Numeric Column expressions that Spark does not ship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def rnd(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded double without negative zero, the output policy for computed values."""
    return F.round(_col(c).cast("double"), digits) + F.lit(0.0)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den as double; `default` where the denominator is zero or null."""
    safe = F.when(den != 0, num.cast("double") / den.cast("double"))
    return safe if default is None else F.coalesce(safe, F.lit(float(default)))


def xlogx(c: Column) -> Column:
    """c * ln(c), zero at zero."""
    d = c.cast("double")
    return F.when(d > 0, d * F.log(d)).otherwise(F.lit(0.0))


def lgamma(c: Column) -> Column:
    """ln Gamma(z) for z > 0: raise the argument by ten, then Stirling to the -7th power.

    ln Gamma(z) = ln Gamma(z + 10) - ln(z (z+1) ... (z+9)). Branch free, so it stays
    inside generated code; the product is finite for every z below 1e30.
    """
    z = c.cast("double")
    rising = reduce(lambda acc, i: acc * (z + float(i)), range(1, 10), z)
    y = z + 10.0
    inv2 = F.lit(1.0) / (y * y)
    series = (
        F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680)))
    ) / y
    half_log_2pi = 0.9189385332046727
    return (y - 0.5) * F.log(y) - y + F.lit(half_log_2pi) + series - F.log(rising)


def log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k); null when k > n."""
    return F.when(n >= k, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def fisher_alpha(species: Column, individuals: Column, steps: int = 100, tol: float = 1e-3) -> Column:
    """Fisher's alpha by a fixed-point search started at the richness.

    The value in hand when a step moves less than `tol` is kept, not the step's
    result. At most `steps` in-row iterations after the aggregation.
    """
    s, n = species.cast("double"), individuals.cast("double")

    def advance(acc: Column, _: Column) -> Column:
        a = acc["a"]
        nxt = s / (-F.log(F.lit(1.0) - n / (n + a)))
        settled = acc["done"] | (F.abs(nxt - a) < tol) | nxt.isNull()
        return F.struct(F.when(settled, a).otherwise(nxt).alias("a"), settled.alias("done"))

    start = F.struct(s.alias("a"), F.lit(False).alias("done"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda acc: acc["a"])
    return F.when(n > 1, solved).otherwise(F.lit(0.0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_match(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered rule list: the value of the first condition that holds."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(rest)


def banded(c: Column, bands: list[tuple[float, str]], top: str) -> Column:
    """Half-open classes: the label of the first upper bound above the value, else `top`."""
    rules: list[tuple[Column, object]] = [(c < bound, label) for bound, label in bands]
    return F.when(c.isNotNull(), first_match(rules, top))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
