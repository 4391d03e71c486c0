"""Joining and reconciling tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import null_safe_equal


def pair_merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", suffix: str = "_right") -> DataFrame:
    """Equi-join in which null keys match; columns that clash get a suffix on the right."""
    clashes = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in clashes})
    a, b = left.alias("a"), renamed.alias("b")
    condition = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in on])
    others = [F.col(f"b.`{c}`") for c in renamed.columns if c not in on]
    return a.join(b, condition, how).select(*[F.col(f"a.`{c}`") for c in left.columns], *others)


def discrepancies(merged: DataFrame, columns: list[str], suffix: str = "_right") -> DataFrame:
    """For each clashing column, the rows where both sides differ; a null differs from everything."""
    counts = [F.count_if(~F.coalesce(F.col(c) == F.col(f"{c}{suffix}"), F.lit(False))).alias(c) for c in columns]
    return merged.agg(*counts).unpivot([], columns, "column_name", "n_different")


def reconcile(merged: DataFrame, columns: list[str], suffix: str = "_right") -> DataFrame:
    """Clashing columns fill each other's nulls; where they then agree everywhere, one stays."""
    filled = {}
    for c in columns:
        filled[c] = F.coalesce(F.col(c), F.col(f"{c}{suffix}"))
        filled[f"{c}{suffix}"] = F.coalesce(F.col(f"{c}{suffix}"), F.col(c))
    out = merged.withColumns(filled)
    if not columns:
        return out
    same = out.agg(*[F.coalesce(F.bool_and(F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))), F.lit(True)).alias(c) for c in columns]).first()
    return out.drop(*[f"{c}{suffix}" for c in columns if same[c]])


def sequential_merge(tables: dict[str, DataFrame], on: list[str], how: str = "left") -> DataFrame:
    """Merge tables in the given order, the first on the left; the suffix is the table's name."""
    names = list(tables)
    out = tables[names[0]]
    for name in names[1:]:
        clashes = [c for c in tables[name].columns if c in out.columns and c not in on]
        out = reconcile(pair_merge(out, tables[name], on, how, f"_{name}"), clashes, f"_{name}")
    return out


def common_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, list[str]]]:
    """For every pair of tables, the names of the columns both have."""
    return [(a, b, [c for c in tables[a].columns if c in tables[b].columns]) for a, b in combinations(tables, 2)]


def common_values(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """For every pair of tables, the rows of the first whose value of a column the second has too."""
    parts = []
    for a, b in combinations(tables, 2):
        left, right = tables[a].select(column).where(F.col(column).isNotNull()), tables[b].select(column).distinct()
        n = left.join(right, column, "left_semi").agg(F.count(F.lit(1)).alias("n_common"))
        parts.append(n.select(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"), "n_common"))
    return reduce(DataFrame.union, parts)


def zip_rows(left: DataFrame, right: DataFrame, ordinal: str = "_row", suffix: str = "_synth") -> DataFrame:
    """Pair rows by position; both tables carry the ordinal."""
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c != ordinal})
    return left.join(renamed, ordinal)


def semi_join(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among the given keys, null keys included."""
    return df.join(keys, null_safe_equal(df, keys, on), "left_semi")
