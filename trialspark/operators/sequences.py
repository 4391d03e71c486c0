"""Longitudinal features, sequences and tokens.

Rows of a subject have an explicit order; nothing relies on the order of rows in
a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import floor_days, md5_rank_key, micros, seconds_in_day

# Special tokens in the order of their ids.
SPECIAL_TOKENS = ["[UNK]", "[START_EVENT]", "[PAD]", "[CLS]", "[MASK]", "[BOS]", "[EOS]", "[MISSING]"]
UNK, SEP, PAD, CLS, MASK, BOS, EOS, MISSING = SPECIAL_TOKENS
SPECIAL_FIELD = "SPECIAL"


def time_diff(df: DataFrame, keys: list[str], ts: str, order: list[str], unit: str = "days", name: str = "T_diff") -> DataFrame:
    """Time since the subject's previous record, 0 for the first; days, seconds within the day, or raw nanoseconds."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
    value = {
        "days": lambda: floor_days(ts, before),
        "seconds": lambda: seconds_in_day(ts, before),
        "raw": lambda: (micros(ts) - micros(before)) * 1000,
        "total_seconds": lambda: F.floor((micros(ts) - micros(before)) / F.lit(1_000_000)).cast("bigint"),
    }[unit]()
    return df.withColumn(name, F.coalesce(value, F.lit(0).cast("bigint")))


def interpolate(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Nulls between two values lie on the line between them by position; later nulls repeat the last value."""
    subject = Window.partitionBy(*keys).orderBy(*order)
    up, down = subject.rowsBetween(Window.unboundedPreceding, 0), subject.rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("_p", F.row_number().over(subject))
    at = F.when(F.col(column).isNotNull(), F.col("_p"))
    rows = rows.withColumns(
        {"_v0": F.last(column, True).over(up), "_p0": F.last(at, True).over(up), "_v1": F.first(column, True).over(down), "_p1": F.first(at, True).over(down)}
    )
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_p") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    value = F.when(F.col(column).isNotNull(), F.col(column).cast("double")).when(F.col("_p1").isNull(), F.col("_v0").cast("double")).when(F.col("_p0").isNotNull(), between)
    return rows.withColumn(column, value).drop("_p", "_v0", "_p0", "_v1", "_p1")


def fill_by_position(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """A null takes the mean over all subjects of the values at its position."""
    rows = df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    means = rows.groupBy("_p").agg(F.avg(column).alias("_mean"))
    return rows.join(means, "_p", "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_mean"))).drop("_p", "_mean")


def day_count(df: DataFrame, keys: list[str], ts: str, order: list[str], name: str = "day_count", fill: bool = True) -> DataFrame:
    """Whole days since the subject's first time; missing times are interpolated, then filled by position."""
    first = F.min(ts).over(Window.partitionBy(*keys))
    out = df.withColumn(name, floor_days(ts, first).cast("double"))
    if fill:
        out = fill_by_position(interpolate(out, keys, order, name), keys, order, name)
    return out.withColumn(name, F.col(name).cast("bigint"))


def start_by_key(df: DataFrame, keys: list[str], key_column: str, key_value: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each subject's rows with a key value, the first non-null value of every column."""
    rows = df.where(F.col(key_column) == key_value)
    ordered = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(c) for c in columns])


def start_by_priority(df: DataFrame, keys: list[str], key_column: str, key_value: str, ts: str, order: list[str]) -> DataFrame:
    """Each subject's first row with the key value, else its earliest, else its first."""
    is_key = F.coalesce(F.col(key_column) == key_value, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(is_key.desc(), F.col(ts).asc_nulls_last(), *order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def vertical_sequences(df: DataFrame, keys: list[str], order: list[str], row_key: list[str], max_len: int, min_len: int, seed: int = 42, static: tuple[str, ...] = ()) -> DataFrame:
    """Subjects with at least ``min_len`` rows; longer than ``max_len``: the first, the last and a random choice between.

    Static columns take the value of the subject's first row.
    """
    subject = Window.partitionBy(*keys)
    ordered = subject.orderBy(*order)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(subject), "_i": F.row_number().over(ordered)}).where(F.col("_n") >= min_len)
    rows = rows.withColumns({c: F.first(c).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in static})
    edge = (F.col("_i") == 1) | (F.col("_i") == F.col("_n"))
    rows = rows.withColumn("_edge", edge).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_edge").orderBy(md5_rank_key(seed, *row_key), *row_key)))
    keep = (F.col("_n") <= max_len) | F.col("_edge") | (F.col("_r") <= max_len - 2)
    return rows.where(keep).drop("_n", "_i", "_edge", "_r")


def _events(keys: list[str], order: list[str], static: list[str], events: list[str]) -> list[Column]:
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.array(*[as_text(c) for c in events]).alias("event"), F.array(*[as_text(c) for c in static]).alias("static"))
    return [F.array_sort(F.collect_list(row)).alias("rows")]


def join_tokens(static: Column, events: Column, sep: str | None = SEP) -> Column:
    """Static tokens, then the events, a separator before each event if there is one."""
    if sep is None:
        return F.concat(static, F.flatten(events))
    return F.concat(static, F.flatten(F.transform(events, lambda e: F.concat(F.array(F.lit(sep)), e))))


def recent_sequences(df: DataFrame, keys: list[str], order: list[str], static: list[str], events: list[str], max_events: int, min_len: int, sep: str | None = SEP) -> DataFrame:
    """Flat sequences of subjects with more than ``min_len`` records: all events, or the first and the last ``max_events + 1``.

    A subject of ``max_events + 1`` records has its first one twice.  ``n_events`` is the reported number, at most ``max_events``.
    """
    grouped = df.groupBy(*keys).agg(*_events(keys, order, static, events)).withColumn("n", F.size("rows")).where(F.col("n") > min_len)
    every = F.transform("rows", lambda r: r["event"])
    cut = F.when(F.col("n") > max_events, F.concat(F.slice(every, 1, 1), F.slice(every, -(max_events + 1), max_events + 1))).otherwise(every)
    first = F.element_at("rows", 1)["static"]
    return grouped.select(*keys, join_tokens(first, cut, sep).alias("sequence"), F.least("n", F.lit(max_events)).alias("n_events"))


def sampled_sequences(df: DataFrame, keys: list[str], order: list[str], static: list[str], events: list[str], max_events: int, min_len: int, samples: int, seed: int = 42, sep: str | None = SEP) -> DataFrame:
    """As W7, but longer subjects give several sequences: first, a random ordered choice, last; equal choices once."""
    grouped = df.groupBy(*keys).agg(*_events(keys, order, static, events)).withColumn("n", F.size("rows")).where(F.col("n") > min_len)
    drawn = grouped.withColumn("sample", F.explode(F.when(F.col("n") > max_events, F.sequence(F.lit(0), F.lit(samples - 1))).otherwise(F.array(F.lit(0)))))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    middle = F.when(F.col("n") > 2, F.sequence(F.lit(2), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    ranked = F.array_sort(F.transform(middle, lambda i: F.struct(F.md5(F.concat_ws(":", key, F.col("sample").cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, max_events - 2), lambda s: s["i"]))
    drawn = drawn.withColumn("index", F.when(F.col("n") > max_events, F.concat(F.array(F.lit(1)), chosen, F.array("n"))).otherwise(F.sequence(F.lit(1), F.col("n"))))
    first_of = F.row_number().over(Window.partitionBy(*keys, "index").orderBy("sample"))
    drawn = drawn.withColumn("_r", first_of).where("_r = 1")
    picked = F.transform("index", lambda i: F.element_at(F.col("rows"), i)["event"])
    return drawn.select(*keys, "sample", join_tokens(F.element_at("rows", 1)["static"], picked, sep).alias("sequence"), F.least("n", F.lit(max_events)).alias("n_events"))


def sequences_to_table(df: DataFrame, id_column: str, sequence: str, static: list[str], events: list[str], sep: str = SEP, bos: str = BOS) -> DataFrame:
    """One row for each event of a flat sequence, the static tokens repeated; ``position`` counts events from 1."""
    tokens = F.filter(sequence, lambda t: t != bos)
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == sep, i + 1)), lambda i: i.isNotNull())
    rows = df.select(id_column, tokens.alias("t"), at.alias("at"))
    rows = rows.select(id_column, "t", F.posexplode("at").alias("k", "start"), "at")
    rows = rows.withColumn("event", F.slice("t", F.col("start") + 1, F.coalesce(F.get("at", F.col("k") + 1), F.size("t") + 1) - F.col("start") - 1))
    return rows.where(F.size("event") == len(events)).select(
        id_column, (F.col("k") + 1).alias("position"), *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate(static)], *[F.get("event", F.lit(i)).alias(c) for i, c in enumerate(events)]
    )


def wrap(sequence: Column, eos: bool = True) -> Column:
    """BOS in front, EOS behind unless the sequence is to be continued."""
    return F.concat(F.array(F.lit(BOS)), sequence, F.array(F.lit(EOS))) if eos else F.concat(F.array(F.lit(BOS)), sequence)


def pad(df: DataFrame, sequence: str, length: int | None = None) -> DataFrame:
    """Pad to the longest sequence (or ``length``) and add attention_mask, 0 on padding."""
    if length is None:
        length = df.agg(F.max(F.size(sequence))).first()[0] or 0
    padded = F.concat(F.col(sequence), F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - F.size(sequence), F.lit(0))))
    out = df.withColumn(sequence, padded)
    return out.withColumn("attention_mask", F.transform(sequence, lambda t: (t != PAD).cast("int")))


def field_mask(tokens: Column, static: list[str], events: list[str]) -> Column:
    """The field each token belongs to: a mark, the static fields, then events of a separator and the event fields."""
    names = F.array(*[F.lit(c) for c in static])
    cycle = F.array(F.lit(SPECIAL_FIELD), *[F.lit(c) for c in events])

    def name(t: Column, i: Column) -> Column:
        k = i - 1 - len(static)
        by_place = F.when(i == 0, F.lit(SPECIAL_FIELD)).when(k < 0, F.get(names, i - 1)).otherwise(F.get(cycle, F.pmod(k, F.lit(len(events) + 1)).cast("int")))
        return F.when(t.isin(BOS, EOS, PAD, SEP, CLS, MASK), F.lit(SPECIAL_FIELD)).otherwise(by_place)

    return F.transform(tokens, name)


def vocabulary(df: DataFrame, fields: list[str], count_fields: tuple[str, ...] = ()) -> DataFrame:
    """(field, token, global_id, local_id): special tokens first, then field by field.

    Tokens of a field go by decreasing frequency, ties by text; a count field has
    every whole number from its least to its greatest value.
    """
    from functools import reduce

    special = df.sparkSession.createDataFrame([(SPECIAL_FIELD, t, i, i) for i, t in enumerate(SPECIAL_TOKENS)], "field string, token string, global_id bigint, local_id bigint")
    parts = []
    for i, c in enumerate(fields):
        if c in count_fields:
            ends = df.agg(F.min(c).cast("bigint").alias("a"), F.max(c).cast("bigint").alias("b")).where("a is not null")
            rows = ends.select(F.posexplode(F.sequence("a", "b")).alias("k", "token")).select(F.col("token").cast("string").alias("token"), (-F.col("k")).cast("bigint").alias("n"))
        else:
            text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            rows = df.groupBy(text.alias("token")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(rows.select(F.lit(i).alias("place"), F.lit(c).alias("field"), "token", "n"))
    every = reduce(DataFrame.unionByName, parts)
    local = F.row_number().over(Window.partitionBy("place").orderBy(F.col("n").desc(), "token"))
    sizes = every.groupBy("place").agg(F.count(F.lit(1)).alias("size"))  # a row for each field
    before = sizes.select("place", F.coalesce(F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = every.withColumn("local_id", (local - 1).cast("bigint")).join(F.broadcast(before), "place")
    return special.unionByName(named.select("field", "token", (F.col("local_id") + F.col("before") + len(SPECIAL_TOKENS)).alias("global_id"), "local_id"))


def encode(df: DataFrame, key: list[str], tokens: str, fields: str, vocab: DataFrame) -> DataFrame:
    """Token ids of sequences, by field and token; an unknown token is an error."""
    each = df.select(*key, F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col(fields).alias("field"))).alias("i", "x"))
    each = each.select(*key, "i", F.col("x.token").alias("token"), F.col("x.field").alias("field"))
    found = each.join(vocab.select("field", "token", "global_id"), ["field", "token"], "left")
    checked = F.when(F.col("global_id").isNull(), F.raise_error(F.concat(F.lit("token not in the vocabulary: "), F.col("field"), F.lit("/"), F.col("token"))).cast("bigint")).otherwise(F.col("global_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("i", checked.alias("id")))), lambda s: s["id"])
    return found.groupBy(*key).agg(ids.alias("ids"))


def decode(df: DataFrame, key: list[str], ids: str, vocab: DataFrame) -> DataFrame:
    """Tokens of id sequences."""
    each = df.select(*key, F.posexplode(ids).alias("i", "global_id")).join(vocab.select("global_id", "token"), "global_id")
    return each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda s: s["token"]).alias("tokens"))


def tokenise(df: DataFrame, keys: list[str], order: list[str], static: list[str], events: list[str], max_events: int, min_len: int) -> DataFrame:
    """Sequences to padded ids with attention and field masks."""
    flat = recent_sequences(df, keys, order, static, events, max_events, min_len)
    wrapped = pad(flat.withColumn("tokens", wrap(F.col("sequence"))).drop("sequence"), "tokens")
    masked = wrapped.withColumn("fields", field_mask(F.col("tokens"), static, events))
    vocab = vocabulary(df, static + events)
    return masked.join(encode(masked, keys, "tokens", "fields", vocab), keys)
