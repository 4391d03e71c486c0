"""Generators that need no deep-learning library (U3, U4, U6, U7's decoding, S13).

Gaussian mixture, Gaussian copula and a first-order Markov chain over events.
GANs, diffusion models, TVAE, PAR and the transformer are out of scope.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.expressions import count_at_or_below


def toy_grid(spark: SparkSession, n: int = 500, outliers: int = 5, seed: int = 42, spread: tuple[float, float] = (0.1, 0.3)) -> DataFrame:
    """Points around a 3 by 3 grid, each cloud turned by its own angle, and outliers around 3 with deviation 6."""
    cell = F.pmod(F.col("id"), F.lit(9))
    angle = cell.cast("double") * F.lit(np.pi / 9)
    a, b = F.randn(seed) * spread[0], F.randn(seed + 1) * spread[1]
    inner = F.col("id") < n - outliers
    rows = spark.range(n).select("id", cell.alias("cell"), a.alias("a"), b.alias("b"), angle.alias("t"), F.randn(seed + 2).alias("c"), F.randn(seed + 3).alias("d"))
    x = F.floor(F.col("cell") / 3) - 1 + F.col("a") * F.cos("t") - F.col("b") * F.sin("t")
    y = F.pmod(F.col("cell"), F.lit(3)) - 1 + F.col("a") * F.sin("t") + F.col("b") * F.cos("t")
    return rows.select("id", F.when(inner, x).otherwise(3 + 6 * F.col("c")).alias("x"), F.when(inner, y).otherwise(3 + 6 * F.col("d")).alias("y"))


@dataclass
class GaussianCopula:
    """U4: normal scores of the columns, their correlation, and quantiles to go back."""

    columns: list[str]
    quantiles: dict[str, list[float]]
    root: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], knots: int = 201) -> GaussianCopula:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation

        shares = [k / (knots - 1) for k in range(knots)]
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100_000).alias(c) for c in columns]).first()
        quantiles = {c: list(row[c]) for c in columns}
        normal = [NormalDist().inv_cdf(min(max(s, 0.5 / knots), 1 - 0.5 / knots)) for s in shares]
        scores = {}
        for c in columns:  # the place of a value among the quantiles gives its normal score
            scores[c] = F.get(F.array(*map(F.lit, normal)), count_at_or_below(quantiles[c][1:], F.col(c)))
        rows = df.dropna(subset=columns).select(*[v.alias(c) for c, v in scores.items()])
        vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(rows)
        corr = Correlation.corr(vectors, "v").first()[0].toArray()
        return cls(columns, quantiles, np.linalg.cholesky(np.nan_to_num(corr) + 1e-9 * np.eye(len(columns))))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        z = [F.randn(seed + k) for k in range(len(self.columns))]
        rows = spark.range(n).select("id", *[x.alias(f"z{k}") for k, x in enumerate(z)])
        out = []
        for i, c in enumerate(self.columns):
            score = sum((F.col(f"z{k}") * float(self.root[i, k]) for k in range(i + 1)), F.lit(0.0))
            # logistic form of the normal distribution function: no UDF
            share = 1 / (1 + F.exp(-(1.5976 * score + 0.070566 * score * score * score)))
            q = F.array(*map(F.lit, self.quantiles[c]))
            at = share * (len(self.quantiles[c]) - 1)
            low = F.least(F.floor(at).cast("int"), F.lit(len(self.quantiles[c]) - 2))
            out.append((F.get(q, low) + (F.get(q, low + 1) - F.get(q, low)) * (at - low)).alias(c))
        return rows.select("id", *out)


class GaussianMixture:
    """Full-covariance mixture by EM, and samples from it."""

    def __init__(self, k: int = 3, max_iter: int = 50, seed: int = 0):
        self.k, self.max_iter, self.seed = k, max_iter, seed

    def fit(self, df: DataFrame, columns: list[str]) -> GaussianMixture:
        from pyspark.ml.clustering import GaussianMixture as Mixture
        from pyspark.ml.feature import VectorAssembler

        vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns).select(*[F.col(c).cast("double").alias(c) for c in columns]))
        model = Mixture(k=self.k, maxIter=self.max_iter, seed=self.seed).fit(vectors)
        self.columns, self.weights = columns, list(model.weights)
        parts = model.gaussiansDF.collect()
        self.means = [np.array(r["mean"].toArray()) for r in parts]
        self.roots = [np.linalg.cholesky(r["cov"].toArray() + 1e-9 * np.eye(len(columns))) for r in parts]
        return self

    def sample(self, spark: SparkSession, n: int) -> DataFrame:
        edges = np.cumsum(self.weights)
        u = F.rand(self.seed)
        rows = spark.range(n).select("id", u.alias("u"), *[F.randn(self.seed + 1 + i).alias(f"z{i}") for i in range(len(self.columns))])
        part = F.least(F.aggregate(F.array(*map(F.lit, edges[:-1].tolist())), F.lit(0), lambda s, e: s + (F.col("u") > e).cast("int")), F.lit(self.k - 1)) if self.k > 1 else F.lit(0)
        out = []
        for i, c in enumerate(self.columns):
            value = F.get(F.array(*[F.lit(float(m[i])) for m in self.means]), part)
            for j in range(i + 1):
                value = value + F.get(F.array(*[F.lit(float(r[i, j])) for r in self.roots]), part) * F.col(f"z{j}")
            out.append(value.alias(c))
        return rows.select("id", *out)


def transition_shares(df: DataFrame, keys: list[str], order: list[str], event: str) -> DataFrame:
    """U6 baseline: share of each next event after an event: (event, following, share); a start and an end have marks."""
    from pyspark.sql import Window

    subject = Window.partitionBy(*keys).orderBy(*order)
    steps = df.select(*keys, *order, F.col(event).alias("following"), F.coalesce(F.lag(event).over(subject), F.lit("[BOS]")).alias("event"))
    ends = df.withColumn("_last", F.lead(event).over(subject).isNull()).where("_last").select(F.col(event).alias("event"), F.lit("[EOS]").alias("following"))
    counts = steps.select("event", "following").unionByName(ends).groupBy("event", "following").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("event"))).drop("n")


def restricted_choice(logits: np.ndarray, allowed: np.ndarray, temperature: float | None = None, rng: np.random.Generator | None = None) -> int:
    """Next token among a field's ids: the greatest logit, or a draw from the softmax at a temperature."""
    values = logits[allowed]
    if temperature is None:
        return int(allowed[int(values.argmax())])
    p = np.exp((values - values.max()) / temperature)
    return int((rng or np.random.default_rng()).choice(allowed, p=p / p.sum()))
