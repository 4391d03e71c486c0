"""Subjects, splits, samples and ids.

Samples are ranked by the md5 of a key and a seed, so a sample depends on the
rows alone and any engine draws the same one.  Ranks over a whole table come from
ranges that are written once (``ranging``), not from one sorted partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import md5_rank_key
from trialspark.operators.merge import semi_join
from trialspark.operators.ranging import with_ordinal


def hash_ranked(df: DataFrame, key: list[str], seed: str | int, name: str = "_rank") -> DataFrame:
    """Number rows 0, 1, ... in the order of the md5 of their key."""
    hashed = df.withColumn("_hash", md5_rank_key(seed, *key))
    return with_ordinal(hashed, ["_hash", *key], name).drop("_hash")


def group_nonnull(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all present: grouping ignores null keys."""
    return df.dropna(subset=keys)


def static_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whether every subject has exactly one value of a column: (column_name, is_static)."""
    per = group_nonnull(df, keys).groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in columns])
    flags = per.agg(*[F.coalesce(F.bool_and(F.col(c) == 1), F.lit(False)).alias(c) for c in columns])
    return flags.unpivot([], columns, "column_name", "is_static")


def static_cardinality(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct values of the columns that are static."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "n_values")
    return counts.join(static_columns(df, keys, columns).where("is_static"), "column_name").select("column_name", "n_values")


def value_counts(df: DataFrame, columns: list[str], keep_null: bool = False) -> DataFrame:
    """A10: rows for each combination of values."""
    return (df if keep_null else group_nonnull(df, columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def drop_singletons(df: DataFrame, column: str) -> DataFrame:
    """Leave out rows whose value occurs once; null values have no group and go."""
    many = group_nonnull(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(column)
    return df.join(many, column, "left_semi")


def grouped_split(df: DataFrame, keys: list[str], share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test); all rows of a subject on one side, ceil(n * share) subjects in the test."""
    subjects = df.select(*keys).distinct()
    n = subjects.count()
    ranked = hash_ranked(subjects, keys, seed)
    cut = int(np.ceil(n * share))
    test = ranked.where(F.col("_rank") < cut).select(*keys)
    train = ranked.where(F.col("_rank") >= cut).select(*keys)
    return semi_join(df, train, keys), semi_join(df, test, keys)


def three_way_split(df: DataFrame, key: list[str], train: float, validation: float, seed: int) -> DataFrame:
    """Rows labelled train, validation or test; sizes are rounded down and the rest is test."""
    n = df.count()
    a = int(n * train)
    b = a + int(n * validation)
    ranked = hash_ranked(df, key, seed)
    label = F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "validation").otherwise("test")
    return ranked.withColumn("part", label).drop("_rank")


def same_size(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """L1: both tables cropped to the length of the shorter one, first rows kept; adds the ordinal ``_row``."""
    a, b = with_ordinal(left, left_order), with_ordinal(right, right_order)
    n = min(left.count(), right.count())
    return a.where(F.col("_row") < n), b.where(F.col("_row") < n)


def mix(real: DataFrame, synth: DataFrame, key: list[str], fraction: float, seed: str | int = 0) -> DataFrame:
    """L4: a table like ``synth`` in which int(n * fraction) rows were replaced by as many of ``real``."""
    return blend_grid(real, synth, key, [fraction], seed).drop("dataset_id", "fraction")


def blend_grid(real: DataFrame, synth: DataFrame, key: list[str], fractions: list[float], seed: str | int = 0) -> DataFrame:
    """One blend for each fraction in a single plan: rows carry dataset_id and fraction."""
    if set(real.columns) != set(synth.columns):
        raise ValueError("both tables need the same columns")
    n = synth.count()
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f"), F.lit(int(n * f)).alias("n")) for i, f in enumerate(fractions)]))
    r = hash_ranked(real, key, f"r{seed}").withColumn("g", grid).where(F.col("_rank") < F.col("g.n"))
    s = hash_ranked(synth, key, f"s{seed}").withColumn("g", grid).where(F.col("_rank") >= F.col("g.n"))
    columns = [F.col("g.i").alias("dataset_id"), F.col("g.f").alias("fraction"), *real.columns]
    return r.select(*columns).unionByName(s.select(*columns))


def assign_unique_ids(df: DataFrame, group: list[str], value_column: str, value_order: list[str]) -> DataFrame:
    """Ids GGG-NNN: number of the group and of the row within it, rows in a given order of values."""
    position = F.array_position(F.array(*[F.lit(v) for v in value_order]), F.col(value_column))
    members = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(position, value_column)))
    groups = with_ordinal(df.select(*group).distinct(), group, "_g")
    numbered = members.join(groups, group)
    text = lambda c: F.when(F.length(c.cast("string")) >= 3, c.cast("string")).otherwise(F.lpad(c.cast("string"), 3, "0"))
    return numbered.withColumn("unique_id", F.concat(text(F.col("_g") + 1), F.lit("-"), text(F.col("_n")))).drop("_n", "_g")


def row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Whole numbers from 1 on."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return with_ordinal(df, order, "_row").withColumn(name, F.col("_row") + 1).drop("_row")


def assign_ids_by_grouping(df: DataFrame, group: list[str], order: list[str], sizes: dict[int, float], secondary: list[str], seed: int = 0) -> DataFrame:
    """Cut every group into subjects of sizes drawn by their probabilities; the last subject takes what is left.

    Adds primary_id (numbered over all groups, zero-padded) and secondary_id (cyclic
    within a subject).  Groups are drawn independently; a running count of subjects
    over the groups, one number each, makes the numbers global.
    """
    values = np.array(list(sizes), dtype=int)
    shares = np.array(list(sizes.values()), dtype=float)
    shares /= shares.sum()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cuts = []
            for n, h in zip(f["_n"], f["_h"], strict=True):
                rng = np.random.default_rng([seed, int(h) & 0xFFFFFFFF])
                drawn, total = [], 0
                while total < n:
                    drawn.append(min(int(rng.choice(values, p=shares)), n - total))
                    total += drawn[-1]
                cuts.append(drawn)
            yield f.assign(_sizes=cuts)

    from pyspark.sql import types as T

    counts = df.groupBy(*group).agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_h", F.xxhash64(*group))
    schema = T.StructType([*counts.schema.fields, T.StructField("_sizes", T.ArrayType(T.IntegerType()))])
    drawn = with_ordinal(counts.mapInPandas(draw, schema), group, "_g")
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    drawn = drawn.withColumn("_first", F.coalesce(F.sum(F.size("_sizes")).over(before), F.lit(0)))
    subject = drawn.select(*group, F.posexplode("_sizes").alias("_k", "_size"), "_first")
    slots = subject.withColumn("_end", F.sum("_size").over(Window.partitionBy(*group).orderBy("_k")))
    slots = slots.select(*group, (F.col("_first") + F.col("_k") + 1).alias("_id"), F.explode(F.sequence(F.col("_end") - F.col("_size"), F.col("_end") - 1)).alias("_pos"), (F.col("_end") - F.col("_size")).alias("_start"))
    rows = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    joined = rows.join(slots, [*group, "_pos"])
    names = F.array(*[F.lit(s) for s in secondary])
    number = F.col("_id").cast("string")
    return (
        joined.withColumn("primary_id", F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0")))
        .withColumn("secondary_id", F.get(names, ((F.col("_pos") - F.col("_start")) % len(secondary)).cast("int")))
        .drop("_pos", "_id", "_start")
    )
