"""Places and running totals over whole tables without one sorted task.

A table is ranged by its order and written once with the number of the range and
the place within it.  Everything that follows reads what was written, so ranges
and their counts belong together however often the plan is evaluated; a row for
each range is all that a single task ever sorts.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.storage import materialise


def ranged(df: DataFrame, order: list[str], tag: str = "ranged") -> DataFrame:
    """The rows in ranges of an order, written: adds _part, the range, and _place, the row's place in it from 0."""
    parts = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return materialise(parts.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), tag)


def with_ordinal(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Number rows 0, 1, ... in an order; rows that are equal in it are numbered in any order, the same in every evaluation."""
    rows = ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def with_running_totals(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds <column>_before, the sum over the rows before, and <column>_total, over all; one row for each value of the order.

    Also adds _next, the following value of the order (null at the end).
    """
    rows = ranged(df, [order])
    per = rows.groupBy("_part").agg(F.min(order).alias("_low"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = per.select(
        "_part",
        F.lead("_low").over(Window.orderBy("_part")).alias("_after"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns],
        *[F.sum(f"_s_{c}").over(every).alias(f"{c}_total") for c in columns],
    )
    local = Window.partitionBy("_part").orderBy("_place")
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"_b_{c}") for c in columns}
    joined = rows.join(offsets, "_part").withColumns(sums | {"_next": F.coalesce(F.lead(order).over(local), F.col("_after"))})
    return joined.drop("_part", "_place", "_after", *[f"_b_{c}" for c in columns])


def value_counts(df: DataFrame, value: str | Column) -> DataFrame:
    """How often each value occurs, as double: (v, n); nulls left out."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    return rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation between neighbouring ranks; None without values.

    Only the values at the wanted ranks, two for each share, come to the driver.
    """
    run = with_running_totals(value_counts(df, value), "v", ["n"])
    total = run.agg(F.sum("n")).first()[0]
    if not total:
        return None
    places = [s * (total - 1) for s in shares]
    ranks = sorted({r for p in places for r in (floor(p), ceil(p))})
    hit = F.exists(F.array(*[F.lit(r).cast("bigint") for r in ranks]), lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))
    found = run.where(hit).select("v", "n", "n_before").collect()
    at = {r: next(x["v"] for x in found if x["n_before"] <= r < x["n_before"] + x["n"]) for r in ranks}
    return [at[floor(p)] + (at[ceil(p)] - at[floor(p)]) * (p - floor(p)) for p in places]
