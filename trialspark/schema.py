"""Column types and roles of trial tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC, BOOLEAN, CATEGORICAL, DATETIME = "numeric", "boolean", "categorical", "datetime"


def classify_columns(df: DataFrame) -> dict[str, list[str]]:
    """Columns by class; arrays, maps, structs and binaries belong to none."""
    out: dict[str, list[str]] = {NUMERIC: [], BOOLEAN: [], CATEGORICAL: [], DATETIME: []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out[NUMERIC].append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            out[BOOLEAN].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            out[CATEGORICAL].append(f.name)
        elif isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            out[DATETIME].append(f.name)
    return out


def column_order(df: DataFrame) -> list[str]:
    """Canonical order: categorical, numeric, boolean; what belongs to none of these follows."""
    kinds = classify_columns(df)
    first = kinds[CATEGORICAL] + kinds[NUMERIC] + kinds[BOOLEAN]
    return first + [c for c in df.columns if c not in first]


def strip_prefixes(df: DataFrame, prefixes: Iterable[str] = ("cat__", "num__", "bool__")) -> DataFrame:
    """Remove a leading encoder prefix from every column name."""
    names = []
    for c in df.columns:
        hit = next((p for p in prefixes if c.startswith(p)), "")
        names.append(c[len(hit) :])
    return df.toDF(*names)


def as_list(value) -> list:
    """None: empty; a scalar or string: one element; otherwise a list."""
    if value is None:
        return []
    return list(value) if isinstance(value, list | tuple | set) else [value]


def chunked(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def powers_of_two(low: int, high: int) -> list[int]:
    """Powers of two from ``low`` to ``high``, both included if they are."""
    return [1 << k for k in range(high.bit_length()) if low <= 1 << k <= high]


@dataclass(frozen=True)
class TrialSchema:
    """Roles of a trial table's columns."""

    unique_id_cols: list[str]
    static_columns: list[str] = field(default_factory=list)
    event_columns: list[str] = field(default_factory=list)
    time_col: str | None = None
    count_variables: list[str] = field(default_factory=list)
    quasi_identifier_cols: list[str] = field(default_factory=list)
    sensitive_cols: list[str] = field(default_factory=list)
    use_secondary_id: bool = False

    def __post_init__(self):
        if not isinstance(self.use_secondary_id, bool):  # a typo such as "Flase" is truthy
            raise TypeError(f"use_secondary_id must be a boolean, not {self.use_secondary_id!r}")
        overlap = set(self.static_columns) & set(self.event_columns)
        if overlap:
            raise ValueError(f"columns are both static and event columns: {sorted(overlap)}")

    def check(self, df: DataFrame) -> None:
        wanted = {*self.unique_id_cols, *self.static_columns, *self.event_columns, *as_list(self.time_col)}
        missing = wanted - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")

    def metadata(self) -> dict[str, str]:
        """Role of each column, as sequence models want it."""
        roles = {c: "categorical" for c in self.static_columns + self.event_columns}
        roles |= {c: "numerical" for c in self.count_variables}
        roles |= {c: "id" for c in self.unique_id_cols}
        if self.time_col:
            roles[self.time_col] = "sequence_index"
        return roles
