"""Disclosure risk of synthetic records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.prep import MISSING
from trialspark.operators.ranging import value_counts
from trialspark.operators.stats import median_deviation


def _first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, null keys being one key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def qid_matches(real: DataFrame, synth: DataFrame, qid: list[str], order: list[str]) -> DataFrame:
    """First real and first synthetic row of every quasi-identifier that both have; synthetic columns end in _synth."""
    a, b = _first_of_each(real, qid, order).alias("a"), _first_of_each(synth, qid, order).alias("b")
    others = [c for c in synth.columns if c not in qid]
    return a.join(b, _same("a", "b", qid)).select(*[F.col(f"a.`{c}`") for c in real.columns], *[F.col(f"b.`{c}`").alias(f"{c}_synth") for c in others])


def equivalence_classes(real: DataFrame, synth: DataFrame, qid: list[str]) -> DataFrame:
    """Real rows with f_s and f_synth, the sizes of their class in both tables, and I_s, whether both have it.

    A null quasi-identifier is in no class: sizes are 0.
    """
    sizes = lambda df, name: df.dropna(subset=qid).groupBy(*qid).agg(F.count(F.lit(1)).alias(name))
    out = real.join(sizes(real, "f_s"), qid, "left").join(sizes(synth, "f_synth"), qid, "left")
    out = out.fillna(0, ["f_s", "f_synth"])
    return out.withColumn("I_s", ((F.col("f_s") > 0) & (F.col("f_synth") > 0)).cast("int"))


def rs_nominal(real: DataFrame, synth: DataFrame, qid: list[str], column: str, order: list[str], name: str = "R_s") -> DataFrame:
    """1 where a match on the quasi-identifier shows a value that is rare enough to teach something.

    The share p of the value decides: d = 1 - p must exceed sqrt(p (1 - p)), and the
    matched values must be equal.  Unmatched rows are null, 'missing' is 0.
    """
    shares = real.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_k"))
    total = real.agg(F.count(F.lit(1)).alias("_t"))
    shares = shares.crossJoin(F.broadcast(total)).select(column, (F.col("_k") / F.col("_t")).alias("_p"))
    matches = qid_matches(real.select(*qid, *[c for c in order if c not in qid], column), synth.select(*qid, *[c for c in order if c not in qid], column), qid, order)
    scored = matches.join(shares, column, "left")
    equal = F.coalesce(F.col(column) == F.col(f"{column}_synth"), F.lit(False))
    rare = F.coalesce((1 - F.col("_p")) * equal.cast("double") > F.sqrt(F.col("_p") * (1 - F.col("_p"))), F.lit(False))
    scored = scored.select(*qid, rare.cast("int").alias("_rs"))
    a, b = real.alias("a"), scored.alias("b")
    joined = a.join(b, _same("a", "b", qid), "left")
    value = F.when(F.col(f"a.`{column}`") == MISSING, F.lit(0)).otherwise(F.col("b._rs"))
    return joined.select(*[F.col(f"a.`{c}`") for c in real.columns], value.alias(name))


def rs_continuous(real: DataFrame, synth: DataFrame, column: str, breaks: list[float], ordinal: str = "_row", name: str = "R_s") -> DataFrame:
    """1 where the share of the value's class times its distance from the synthetic value at the same position is below the MAD.

    ``breaks`` are the upper ends of the classes but the last.
    """
    edges = F.array(*[F.lit(float(b)) for b in breaks]) if breaks else F.array().cast("array<double>")
    rows = real.withColumn("_class", F.aggregate(edges, F.lit(0), lambda s, b: s + (F.col(column) > b).cast("int")))
    sizes = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_k"))
    total, spread = real.count(), F.lit(median_deviation(real, column)).cast("double")
    paired = rows.join(F.broadcast(sizes), "_class").join(synth.select(ordinal, F.col(column).alias("_y")), ordinal)  # a size for each break
    value = (F.col("_k") / F.lit(total) * F.abs(F.col(column) - F.col("_y")) < spread).cast("int")
    return paired.select(*real.columns, value.alias(name))


def disclosure_risk(scored: DataFrame, n_real: int, n_synth: int, columns: list[str]) -> DataFrame:
    """Risk of each sensitive column from rows with f_s, f_synth, I_s and Rs_<column>: (column_name, risk)."""
    aggs = []
    for c in columns:
        learnt = F.col("I_s") * F.coalesce(F.col(f"Rs_{c}").cast("double"), F.lit(0.0))
        a = F.coalesce(F.sum(F.try_divide(learnt, F.col("f_s").cast("double"))), F.lit(0.0)) / F.lit(n_real)
        b = F.coalesce(F.sum(F.try_divide(learnt, F.col("f_synth").cast("double"))), F.lit(0.0)) / F.lit(n_synth)
        aggs.append(F.greatest(F.bround(a, 4), F.bround(b, 4)).alias(c))
    return scored.agg(*aggs).unpivot([], columns, "column_name", "risk")


def _least_costs(best: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of ``k`` classes of the first j values for every j, and where the last class starts.

    The best start never moves left as j grows, so the middle of a span of ends is
    solved first and bounds the starts of both halves; all spans of a depth are
    solved together.
    """
    n = len(best) - 1
    new, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    low, high, first, last = (np.array([x], dtype=np.int64) for x in (k, n, k - 1, n - 1))
    while len(low):
        middle = (low + high) // 2
        stop = np.minimum(last, middle - 1)
        length = stop - first + 1
        for a in range(0, len(middle), 1 << 16):  # bounds the candidates held at a time
            part = slice(a, a + (1 << 16))
            size = length[part]
            at = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(first[part], size)
            j = np.repeat(middle[part], size)
            cost = best[i] + np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i]), 0)
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, size))
            owner = np.repeat(np.arange(len(size)), size)[hit]
            _, once = np.unique(owner, return_index=True)
            new[middle[part]], start[middle[part]] = least, i[hit[once]]
        left, right = middle > low, middle < high
        at = start[middle]
        low, high, first, last = (
            np.concatenate([low[left], middle[right] + 1]), np.concatenate([middle[left] - 1, high[right]]),
            np.concatenate([first[left], at[right]]), np.concatenate([at[left], last[right]]),
        )
    return new, start


def natural_breaks(values: np.ndarray, weights: np.ndarray, k_max: int) -> list[tuple[float, list[float]]]:
    """Least within-class sum of squares for 1..k_max classes of sorted weighted values, with the classes' upper ends.

    Fisher's dynamic programme, exact: the best k classes of the first j values end
    with a last class that starts at some i.  Time grows with k n log n.
    """
    n = len(values)
    centred = values - np.average(values, weights=weights)  # keeps the sums of squares small
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * centred, weights * centred**2))
    with np.errstate(invalid="ignore", divide="ignore"):
        best = np.concatenate([[0.0], np.maximum(q[1:] - s[1:] ** 2 / w[1:], 0)])
    starts: list[np.ndarray] = []
    out = [(float(best[n]), [])]
    for k in range(2, min(k_max, n) + 1):
        best, start = _least_costs(best, w, s, q, k)
        starts.append(start)
        ends, j = [], n
        for st in reversed(starts):
            j = int(st[j])
            ends.append(float(values[j - 1]))
        out.append((float(best[n]), ends[::-1]))
    return out


def jenks(df: DataFrame, column: str, k_max: int = 20, goodness: float = 0.99) -> tuple[int, list[float], float]:
    """The least number of classes (2 or more) whose goodness of variance fit exceeds a bound: (k, breaks, fit).

    Rows are counted by value on the cluster; the programme then runs on the driver
    over the distinct values, about 250 bytes each with twenty classes.
    """
    pairs = value_counts(df, column).orderBy("v").toPandas()
    values, counts = pairs["v"].to_numpy(dtype=float), pairs["n"].to_numpy(dtype=float)
    if len(values) < 2:
        return 1, [], 1.0
    fits = natural_breaks(values, counts, min(k_max, len(values)))
    whole = fits[0][0]
    for k, (within, ends) in enumerate(fits[1:], 2):
        fit = 1 - within / whole
        if fit > goodness:
            break
    return k, ends, float(fit)
