"""Fitted statistics of columns and series."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import EPSILON, pearson
from trialspark.operators.ranging import exact_quantiles, value_counts, with_running_totals

#: Consistency factor of the median absolute deviation.
MAD_FACTOR = 1.48


def median_deviation(df: DataFrame, column: str) -> float | None:
    """1.48 times the median distance from the median; None without values."""
    middle = exact_quantiles(df, column, [0.5])
    return None if middle is None else MAD_FACTOR * exact_quantiles(df, F.abs(F.col(column) - F.lit(middle[0])), [0.5])[0]


def mad(df: DataFrame, column: str) -> DataFrame:
    """The median absolute deviation as a table of one row."""
    return df.sparkSession.createDataFrame([(median_deviation(df, column),)], "mad double")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Rows in each of ``bins`` equal bins, the last one closed: (bin, n)."""
    ends = df.agg(F.min(column).cast("double").alias("_l"), F.max(column).cast("double").alias("_h"))
    place = F.least(F.floor((F.col(column) - F.col("_l")) / F.nullif(F.col("_h") - F.col("_l"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(reference: DataFrame, column: str, points: DataFrame, point: str) -> DataFrame:
    """Share of reference values at or below each point, from running counts over both."""
    counts = (
        value_counts(reference, column).withColumn("asked", F.lit(0))
        .unionByName(points.where(F.col(point).isNotNull()).select(F.col(point).cast("double").alias("v")).distinct().select("v", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("asked")))
    )
    run = with_running_totals(counts.groupBy("v").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")), "v", ["n"])
    return run.where("asked = 1").select(F.col("v").alias(point), F.try_divide(F.col("n_before") + F.col("n"), F.col("n_total").cast("double")).alias("ecdf"))


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Lag-1 autocorrelation per subject, averaged over subjects that have one: (column_name, value)."""
    subject = Window.partitionBy(*keys).orderBy(*order)
    lagged = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns], *[F.lag(F.col(c).cast("double")).over(subject).alias(f"_lag_{c}") for c in columns])
    per = lagged.dropna(subset=keys).groupBy(*keys).agg(*[pearson(c, f"_lag_{c}").alias(c) for c in columns])
    return per.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "value")


def cross_correlation(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of column pairs per subject, averaged: (column_name, value)."""
    names = [f"{a}|{b}" for a, b in pairs]
    per = df.dropna(subset=keys).groupBy(*keys).agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(n) for (a, b), n in zip(pairs, names, strict=True)])
    return per.agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names]).unpivot([], [f"`{n}`" for n in names], "column_name", "value")


def vector_mse(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Mean squared difference of two (column_name, value) tables over the columns that both have a value for."""
    both = real.join(synth.withColumnRenamed("value", "synth"), "column_name")
    return both.agg(F.avg((F.col("value") - F.col("synth")) * (F.col("value") - F.col("synth"))).alias("mse"))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """Mean of every component: (i, mean)."""
    return df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Sample covariance of components i <= j: (i, j, cov).

    Every task turns its rows into one matrix of sums of products, so what moves
    is a matrix per task, not a row per pair of components.
    """
    import pyarrow as pa

    def moments(batches):
        n, mean, square = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=float)
                m = x.mean(0)
                c = x - m
                if mean is None:
                    n, mean, square = len(x), m, c.T @ c
                else:
                    d = m - mean
                    square = square + c.T @ c + np.outer(d, d) * n * len(x) / (n + len(x))
                    mean = mean + d * len(x) / (n + len(x))
                    n += len(x)
        if n:
            i, j = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), pa.array(mean[i]), pa.array(mean[j]), pa.array(square[i, j])],
                names=["i", "j", "n", "mi", "mj", "s"],
            )

    parts = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda v: v.cast("double")).alias("v")).mapInArrow(moments, "i int, j int, n bigint, mi double, mj double, s double")
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("mi") * F.col("mj")) - F.sum(F.col("n") * F.col("mi")) * F.sum(F.col("n") * F.col("mj")) / total
    return parts.groupBy("i", "j").agg(F.try_divide(F.sum("s") + between, (total - 1).cast("double")).alias("cov"))


def _moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r["mean"] for r in mean_vector(df, vector).orderBy("i").collect()])  # one number for each component
    cov = np.zeros((len(mean), len(mean)))
    for r in covariance(df, vector).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    return mean, cov


def frechet_distance(real: DataFrame, synth: DataFrame, vector: str, eps: float = 1e-6) -> float:
    """|m1 - m2|^2 + tr(C1 + C2 - 2 sqrt(C1 C2)); the product's eigenvalues give the trace of its root."""
    m1, c1 = _moments(real, vector)
    m2, c2 = _moments(synth, vector)
    roots = np.sqrt(np.maximum(np.linalg.eigvals(c1 @ c2).real, 0))
    if not np.isfinite(roots).all():
        offset = np.eye(len(m1)) * eps
        roots = np.sqrt(np.maximum(np.linalg.eigvals((c1 + offset) @ (c2 + offset)).real, 0))
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * roots.sum())


def seed_statistics(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population variance of a score over seeds."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def pmf(df: DataFrame, column: str) -> DataFrame:
    """Share of each value: (v, p)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select("v", (F.col("n") / F.col("_t")).alias("p"))


def _both_pmfs(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    p, q = pmf(real, column), pmf(synth, column).withColumnRenamed("p", "q")
    return p.join(q, "v", "full_outer").select("v", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def kl_divergence(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """M3: sum of p ln(p / q); shares of zero stand as the machine epsilon."""
    p, q = F.greatest("p", F.lit(EPSILON)), F.greatest("q", F.lit(EPSILON))
    return _both_pmfs(real, synth, column).agg(F.sum(p * F.ln(p / q)).alias("kl"))


def js_distance(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """M4: root of the mean of both divergences from the middle distribution."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).otherwise(0.0)
    return _both_pmfs(real, synth, column).agg(F.sqrt(F.greatest((F.sum(part("p")) + F.sum(part("q"))) / 2, F.lit(0.0))).alias("js_distance"))


def wasserstein_1d(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """M5: area between both distribution functions, from running counts by value."""
    rows = (
        real.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("r"), F.lit(0).alias("s"))
        .unionByName(synth.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("r"), F.lit(1).alias("s")))
        .where("v is not null")
    )
    run = with_running_totals(rows.groupBy("v").agg(F.sum("r").alias("r"), F.sum("s").alias("s")), "v", ["r", "s"])
    share = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_total").cast("double"))
    return run.select((F.abs(share("r") - share("s")) * (F.col("_next") - F.col("v"))).alias("area")).agg(F.sum("area").alias("wasserstein"))


def column_kinds(df: DataFrame, columns: list[str], below: int = 10) -> DataFrame:
    """Columns of fewer than ten distinct values are discrete."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "n_values")
    return counts.select("column_name", (F.col("n_values") >= below).alias("is_continuous"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables, by column name."""
    return reduce(DataFrame.unionByName, frames)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, least and greatest value of numeric columns."""
    kinds = [("n", F.count), ("mean", F.avg), ("least", F.min), ("greatest", F.max)]
    parts = [df.agg(*[f(F.col(c).cast("double")).alias(k) for k, f in kinds]).select(F.lit(c).alias("column_name"), *[k for k, _ in kinds]) for c in columns]
    return union_all(parts)
