"""Column expressions that keep the reference's semantics under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest positive double by which 1 can grow; stands in for a share of zero before a logarithm.
EPSILON = 2.220446049250313e-16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone (naive means UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def floor_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole 24-hour periods between two times, rounded down; not calendar days."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("bigint")


def seconds_in_day(later: str | Column, earlier: str | Column) -> Column:
    """Seconds of a time difference beyond its whole days."""
    return F.pmod(F.floor((micros(later) - micros(earlier)) / F.lit(1_000_000)).cast("bigint"), F.lit(86_400).cast("bigint"))


def md5_rank_key(seed: str | int, *columns: str) -> Column:
    """Deterministic stand-in for a random number: the md5 of key columns and a seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def round_half_even_int(c: str | Column) -> Column:
    return F.bround(col(c).cast("double")).cast("bigint")


def is_blank(c: str | Column) -> Column:
    return col(c).rlike(r"^\s*$")


def null_safe_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition under which null keys match each other."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: sample correlation of pairs, null where a variance is zero or there are fewer than two pairs."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)))


def count_at_or_below(edges: list[float], value: Column) -> Column:
    """How many of the sorted edges are at or below a value."""
    if not edges:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (e <= value).cast("int"))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def kernel(name: str, d: str | Column, bandwidth: float = 1.0) -> Column:
    """Kernel value at a distance (L1 for laplace and matern in L1, else L2), as M12 lists them."""
    d = col(d) / F.lit(float(bandwidth))
    r3, r5, r7, r9 = (F.sqrt(F.lit(float(k))) * d for k in (3, 5, 7, 9))
    values = {
        "gaussian": F.exp(-d * d),
        "imq": 1 / F.sqrt(1 + d * d),
        "laplace": F.exp(-d),
        "matern_0.5": F.exp(-d),
        "matern_1.5": (1 + r3) * F.exp(-r3),
        "matern_2.5": (1 + r5 + r5 * r5 / 3) * F.exp(-r5),
        "matern_3.5": (1 + r7 + 2 * r7 * r7 / 5 + r7 * r7 * r7 / 15) * F.exp(-r7),
        "matern_4.5": (1 + r9 + 3 * r9 * r9 / 7 + 2 * r9 * r9 * r9 / 21 + r9 * r9 * r9 * r9 / 105) * F.exp(-r9),
    }
    return values[name]
