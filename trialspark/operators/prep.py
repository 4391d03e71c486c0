"""Typing, cleaning and encoding of columns.

Operators that learn something have a ``fit`` that returns a small frozen object
with ``transform``; what is learnt (a few numbers or a vocabulary per column)
comes from one aggregation and lives on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import count_at_or_below, is_blank, round_half_even_int
from trialspark.operators.ranging import exact_quantiles, value_counts
from trialspark.schema import BOOLEAN, CATEGORICAL, NUMERIC, classify_columns
from trialspark.storage import materialise, release

# Vocabularies that mean yes and no, and the texts that stand for a missing answer beside null.
YES_NO = [
    {"Yes": True, "No": False},
    {"YES": True, "NO": False},
    {"True": True, "False": False},
    {"true": True, "false": False},
    {"TRUE": True, "FALSE": False},
    {"1": True, "0": False},
]
NULL_MARKS = ["", " "]
MISSING = "missing"


@dataclass(frozen=True)
class BooleanMapper:
    """P5: string columns whose values all belong to one yes/no vocabulary become boolean."""

    mappings: dict[str, dict[str, bool]]

    @classmethod
    def fit(cls, df: DataFrame, vocabularies: list[dict[str, bool]] = YES_NO, null_marks: list[str] = NULL_MARKS) -> BooleanMapper:
        columns = classify_columns(df)[CATEGORICAL]
        if not columns:
            return cls({})
        tests = []
        for c in columns:
            for k, v in enumerate(vocabularies):
                allowed = [*v, *null_marks]
                tests.append(F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).isin(allowed)), F.lit(True)).alias(f"{columns.index(c)}:{k}"))
        row = df.agg(*tests).first()
        found = {}
        for i, c in enumerate(columns):
            k = next((k for k in range(len(vocabularies)) if row[f"{i}:{k}"]), None)
            if k is not None:
                found[c] = vocabularies[k]
        return cls(found)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, mapping in self.mappings.items():
            expr = F.lit(None).cast("boolean")
            for text, value in mapping.items():
                expr = F.when(F.col(c) == text, F.lit(value)).otherwise(expr)
            out[c] = expr
        return df.withColumns(out)


def date_text(c: str) -> Column:
    """Whether a string looks like a date: digits, dash, digits, dash, digits in ten characters."""
    return F.col(c).rlike(r"^\d+-\d+-\d+$") & (F.length(c) == 10)


@dataclass(frozen=True)
class HiddenDates:
    """String columns that hold dates become dates; what is no date becomes null."""

    columns: list[str]
    pattern: str = "yyyy-MM-dd"

    @classmethod
    def fit(cls, df: DataFrame, pattern: str = "yyyy-MM-dd") -> HiddenDates:
        columns = classify_columns(df)[CATEGORICAL]
        if not columns:
            return cls([], pattern)
        tests = []
        for i, c in enumerate(columns):
            parsed = F.try_to_date(F.col(c), pattern).isNotNull()
            tests += [F.count_if(date_text(c)).alias(f"n{i}"), F.count_if(date_text(c) & parsed).alias(f"p{i}")]
        row = df.agg(*tests).first()
        return cls([c for i, c in enumerate(columns) if row[f"n{i}"] and row[f"n{i}"] == row[f"p{i}"]], pattern)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(date_text(c), F.try_to_date(F.col(c), self.pattern)) for c in self.columns})


def date_to_unix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Seconds since the epoch at the start of the day, as double."""
    return df.withColumns({c: F.unix_timestamp(F.date_trunc("DAY", F.col(c).cast("timestamp"))).cast("double") for c in columns})


def unix_to_date(df: DataFrame, columns: list[str]) -> DataFrame:
    """The date of seconds since the epoch."""
    return df.withColumns({c: F.to_date(F.timestamp_seconds(F.col(c))) for c in columns})


def optimise_types(df: DataFrame, include_dates: bool) -> DataFrame:
    """Booleans out of strings, then, if asked for, dates out of strings as unix seconds."""
    df = BooleanMapper.fit(df).transform(df)
    if include_dates:
        dates = HiddenDates.fit(df)
        df = date_to_unix(dates.transform(df), dates.columns)
    return df


def cast_columns(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """Cast columns; integers by way of rounding half to even."""
    if to in ("int", "bigint", "long", "integer"):
        return df.withColumns({c: round_half_even_int(c) for c in columns})
    return df.withColumns({c: F.col(c).cast(to) for c in columns})


def round_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """P10: count variables become whole numbers."""
    return cast_columns(df, columns, "bigint")


def copy_nulls(df: DataFrame, source: str, target: str) -> DataFrame:
    """The target is null wherever the source is."""
    return df.withColumn(target, F.when(F.col(source).isNotNull(), F.col(target)))


def replace_matching(df: DataFrame, column: str, replacements: dict[str, str]) -> DataFrame:
    """A cell that matches a pattern anywhere is replaced whole; rules apply in order, each on the result so far."""
    out = F.col(column)
    for pattern, value in replacements.items():
        out = F.when(out.rlike(pattern), F.lit(value)).otherwise(out)
    return df.withColumn(column, out)


def merge_to_string(df: DataFrame, columns: list[str], name: str, separator: str = "_", drop: bool = True) -> DataFrame:
    """One string of several columns; a null prints as nan."""
    out = df.withColumn(name, F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]))
    return out.drop(*[c for c in columns if c != name]) if drop else out


def single_key(df: DataFrame, id_columns: list[str], name: str = "unique_id") -> DataFrame:
    """One key column: several ids are merged, one is renamed."""
    return merge_to_string(df, id_columns, name) if len(id_columns) > 1 else df.withColumnRenamed(id_columns[0], name)


def restore_types(df: DataFrame, integer_columns: list[str], drop: list[str], constants: dict[str, object], n_rows: int | None, order: str) -> DataFrame:
    """P20: after generation: whole numbers where they belong, at most ``n_rows`` rows, constant columns, columns to leave out."""
    out = cast_columns(df, integer_columns, "bigint")
    if n_rows is not None:
        out = out.orderBy(order).limit(n_rows)
    return out.withColumns({c: F.lit(v) for c, v in constants.items()}).drop(*drop)


@dataclass(frozen=True)
class Imputer:
    """A1, A2: mean for numbers, mode (smallest of ties) for booleans, a constant for strings; dates stay as they are."""

    means: dict[str, float]
    modes: dict[str, bool]
    strings: list[str]
    blanks: bool = True

    @classmethod
    def fit(cls, df: DataFrame, blanks: bool = True, exclude: tuple[str, ...] = ()) -> Imputer:
        kinds = {k: [c for c in v if c not in exclude] for k, v in classify_columns(df).items()}
        stats = [F.avg(c).alias(f"n{i}") for i, c in enumerate(kinds[NUMERIC])]
        stats += [F.mode(F.col(c), True).alias(f"b{i}") for i, c in enumerate(kinds[BOOLEAN])]
        row = df.agg(*stats).first() if stats else None
        means = {c: row[f"n{i}"] for i, c in enumerate(kinds[NUMERIC]) if row[f"n{i}"] is not None}
        modes = {c: row[f"b{i}"] for i, c in enumerate(kinds[BOOLEAN]) if row[f"b{i}"] is not None}
        return cls(means, modes, kinds[CATEGORICAL], blanks)

    def transform(self, df: DataFrame) -> DataFrame:
        out: dict[str, Column] = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in self.means.items()}
        out |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.modes.items()}
        for c in self.strings:
            text = F.when(~is_blank(c), F.col(c)) if self.blanks else F.col(c)
            out[c] = F.coalesce(text, F.lit(MISSING))
        return df.withColumns(out)


@dataclass(frozen=True)
class Encoder:
    """A3, A4: one-hot strings (sorted categories, unknown: all zero), min-max numbers (no clipping), booleans as 0/1."""

    categories: dict[str, list[str]]
    ranges: dict[str, tuple[float, float]]
    booleans: list[str]

    @classmethod
    def fit(cls, df: DataFrame, exclude: tuple[str, ...] = ()) -> Encoder:
        kinds = {k: [c for c in v if c not in exclude] for k, v in classify_columns(df).items()}
        stats = [F.sort_array(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(kinds[CATEGORICAL])]
        for i, c in enumerate(kinds[NUMERIC]):
            stats += [F.min(F.col(c).cast("double")).alias(f"l{i}"), F.max(F.col(c).cast("double")).alias(f"h{i}")]
        row = df.agg(*stats).first() if stats else None
        return cls(
            {c: list(row[f"s{i}"]) for i, c in enumerate(kinds[CATEGORICAL])},
            {c: (row[f"l{i}"] or 0.0, row[f"h{i}"] or 0.0) for i, c in enumerate(kinds[NUMERIC])},
            kinds[BOOLEAN],
        )

    @property
    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs] + list(self.ranges) + self.booleans

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        out = [F.col(c) for c in keep]
        for c, values in self.categories.items():
            out += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in values]
        for c, (low, high) in self.ranges.items():
            width = high - low if high > low else 1.0
            out.append(((F.col(c).cast("double") - F.lit(low)) / F.lit(width)).alias(c))
        out += [F.col(c).cast("double").alias(c) for c in self.booleans]
        return df.select(*out)

    def vector(self, df: DataFrame, name: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
        """The encoded columns as one array."""
        encoded = self.transform(df, keep)
        return encoded.select(*keep, F.array(*[F.col(f"`{c}`") for c in self.output_columns]).alias(name))

    def inverse(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        out = [F.col(c) for c in keep]
        for c, values in self.categories.items():
            block = F.array(*[F.col(f"`{c}_{v}`") for v in values])
            at = F.array_position(block, F.array_max(block)).cast("int")
            out.append(F.element_at(F.array(*[F.lit(v) for v in values]), at).alias(c))
        for c, (low, high) in self.ranges.items():
            width = high - low if high > low else 1.0
            out.append((F.col(c) * F.lit(width) + F.lit(low)).alias(c))
        out += [(F.col(c) >= 0.5).alias(c) for c in self.booleans]
        return df.select(*out)


def lloyd_step(values: np.ndarray, weights: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and weighted sum of the values nearest to each centre; a value halfway goes to the upper one."""
    owner = np.searchsorted((centres[1:] + centres[:-1]) / 2, values, side="right")
    return np.bincount(owner, weights=weights, minlength=len(centres)), np.bincount(owner, weights=weights * values, minlength=len(centres))


def lloyd_1d(step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], low: float, high: float, k: int, rounds: int = 300) -> list[float]:
    """One-dimensional k-means; centres start in the middle of equal bins, ``step`` gives weight and sum of each cell."""
    centres = low + (np.arange(k) + 0.5) * (high - low) / k
    for _ in range(rounds):
        total, sums = step(centres)
        new = np.sort(np.where(total > 0, sums / np.where(total > 0, total, 1), centres))
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return [float(c) for c in centres]


def spread_step(counts: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``lloyd_step`` over a table (v, n) of any size: a task sends two numbers for each centre."""

    def step(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros(len(centres)), np.zeros(len(centres))
            for batch in batches:
                a, b = lloyd_step(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), centres)
                total, sums = total + a, sums + b
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(total), pa.array(sums)], names=["k", "total", "sums"])

        rows = counts.mapInArrow(run, "k bigint, total double, sums double").groupBy("k").agg(F.sum("total").alias("total"), F.sum("sums").alias("sums")).collect()
        out = np.zeros((2, len(centres)))
        for r in rows:
            out[:, r["k"]] = r["total"], r["sums"]
        return out[0], out[1]

    return step


@dataclass(frozen=True)
class Binner:
    """Ordinal bins of numeric columns by edges, and back to bin centres; a column without values has no edges and one bin."""

    edges: dict[str, list[float]]
    centres: dict[str, list[float]]

    #: Distinct values up to which k-means runs on the driver; beyond it every round is a job of the same steps.
    KMEANS_VALUES = 1 << 20

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], n_bins: int, strategy: str = "uniform") -> Binner:
        edges: dict[str, list[float]] = {}
        centres: dict[str, list[float]] = {}
        if strategy == "uniform":
            row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("l", F.min), ("h", F.max))]).first()
            for i, c in enumerate(columns):
                low, high = row[f"l{i}"], row[f"h{i}"]
                edges[c] = [] if low is None else [low + (high - low) * k / n_bins for k in range(n_bins + 1)]
        elif strategy == "quantile":
            for c in columns:
                edges[c] = sorted(set(exact_quantiles(df, c, [k / n_bins for k in range(n_bins + 1)]) or []))
        elif strategy == "kmeans":
            for c in columns:
                counts = materialise(value_counts(df, c), "value-counts")
                low, high, n = counts.agg(F.min("v"), F.max("v"), F.count("v")).first()
                if not n:
                    edges[c] = []
                    continue
                step = spread_step(counts)
                if n <= cls.KMEANS_VALUES:
                    held = counts.orderBy("v").toPandas()
                    values, weights = held["v"].to_numpy(), held["n"].to_numpy(dtype=float)
                    step = lambda centres, v=values, w=weights: lloyd_step(v, w, centres)
                centres[c] = lloyd_1d(step, low, high, n_bins)
                release(counts)
                middle = [(a + b) / 2 for a, b in zip(centres[c], centres[c][1:], strict=False)]
                edges[c] = [low, *middle, high]
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        for c, e in edges.items():
            centres.setdefault(c, [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)])
        return cls(edges, centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Number of inner edges at or below the value: bins are closed on the left, the outer ones open-ended."""
        out = {}
        for c, e in self.edges.items():
            inner = e[1:-1]
            out[c] = F.when(F.col(c).isNotNull(), count_at_or_below(inner, F.col(c)))
        return df.withColumns(out)

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.get(F.array(*map(F.lit, m)), F.col(c).cast("int")) if m else F.lit(None).cast("double") for c, m in self.centres.items()})
