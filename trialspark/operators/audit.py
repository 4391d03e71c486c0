"""Trust index: metrics, polarity, reference distribution, dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import EPSILON
from trialspark.operators.stats import union_all

Evaluator = Callable[[DataFrame, DataFrame], DataFrame]


class EvaluatorRegistry:
    """Evaluators by name; each takes (real, synth) and returns (metric, value)."""

    def __init__(self) -> None:
        self.evaluators: dict[str, tuple[Evaluator, dict[str, int]]] = {}

    def add(self, name: str, evaluator: Evaluator, polarity: dict[str, int]) -> None:
        """``polarity``: 1 where more is better, -1 where less is."""
        self.evaluators[name] = (evaluator, polarity)

    def evaluate(self, real: DataFrame, datasets: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        """One long table: dataset_id, evaluator, metric, value, polarity."""
        wanted = names or list(self.evaluators)
        unknown = [n for n in wanted if n not in self.evaluators]
        if unknown:
            raise ValueError(f"unknown evaluators: {unknown}")
        parts = []
        for dataset, synth in datasets.items():
            for name in wanted:
                evaluator, polarity = self.evaluators[name]
                sign = F.coalesce(F.create_map(*[F.lit(x) for kv in polarity.items() for x in kv])[F.col("metric")], F.lit(1))
                parts.append(evaluator(real, synth).select(F.lit(dataset).alias("dataset_id"), F.lit(name).alias("evaluator"), "metric", F.col("value").cast("double").alias("value"), sign.alias("polarity")))
        return union_all(parts)


def wide_to_long(df: DataFrame) -> DataFrame:
    """A one-row table of metrics as rows (metric, value)."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value")


def aligned(metrics: DataFrame) -> DataFrame:
    """Values turned so that more is better."""
    return metrics.withColumn("aligned", F.col("value") * F.col("polarity"))


def normalise(metrics: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Share of the reference values of a metric at or below the aligned value, as ``u``."""
    r = reference.select(*by, F.col("aligned").alias("_ref"))
    joined = metrics.join(r, by)
    own = [c for c in metrics.columns]
    return joined.groupBy(*own).agg(F.avg((F.col("_ref") <= F.col("aligned")).cast("double")).alias("u"))


def aggregate_dimensions(normalised: DataFrame, weights: dict[str, float], dataset: str = "dataset_id") -> DataFrame:
    """Geometric mean of a dimension's metrics, then the weighted product of the dimensions: (dataset, score per dimension, trust_index)."""
    score = F.exp(F.avg(F.ln(F.greatest("u", F.lit(EPSILON)))))
    per = normalised.groupBy(dataset, "dimension").agg(score.alias("score"))
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    wide = per.groupBy(dataset).agg(
        *[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in weights],
        F.exp(F.sum(weight[F.col("dimension")] * F.ln(F.greatest("score", F.lit(EPSILON))))).alias("trust_index"),
    )
    return wide


def best_run(runs: DataFrame, score: str, artifact: str) -> DataFrame:
    """The run of the highest score that has an artifact; ties to the smaller run_id."""
    return runs.where(F.col(artifact)).orderBy(F.col(score).desc_nulls_last(), "run_id").limit(1)


def run_log(spark, path: str, run_id: str, params: dict[str, str], metrics: dict[str, float]) -> None:
    """Append a run to a table of runs."""
    rows = [(run_id, "param", k, str(v), None) for k, v in params.items()] + [(run_id, "metric", k, None, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run_id string, kind string, name string, text string, number double").write.mode("append").parquet(path)


def checkpoint_dir(root: str, name: str) -> str:
    """Path of a new folder for a model's state, by name and time."""
    from datetime import UTC, datetime

    return f"{root.rstrip('/')}/{name}/{datetime.now(UTC):%Y-%m-%d_%H-%M-%S}"


def search_grid(space: dict[str, list], objective: Callable[[dict], float]) -> list[tuple[dict, float | None]]:
    """Every combination of a parameter grid, best first; a failing one is kept with no score."""
    from itertools import product

    out = []
    for values in product(*space.values()):
        params = dict(zip(space, values, strict=True))
        try:
            out.append((params, float(objective(params))))
        except (ValueError, ArithmeticError):
            out.append((params, None))
    return sorted(out, key=lambda r: (r[1] is None, -(r[1] or 0.0)))


def rank_in(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """In-sample distribution function: share of rows of a group at or below each value."""
    return df.withColumn("ecdf", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))
