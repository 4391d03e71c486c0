"""Queries over longitudinal features, sequences and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import sequences as seq
from trialspark.registry import query, table

ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
LAG = f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORDER}) AS us FROM events"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query("time_diff_days", f"SELECT event_id, coalesce(floor(us / 86400000000.0::DOUBLE), 0)::BIGINT AS \"T_diff\" FROM ({LAG})")
def time_diff_days(spark: SparkSession, sf: str) -> DataFrame:
    return seq.time_diff(_events(spark, sf), ["user_id"], "ts", ["ts", "event_id"]).select("event_id", "T_diff")


@query("time_diff_seconds", f"SELECT event_id, coalesce(floor(us / 1000000.0::DOUBLE)::BIGINT % 86400, 0) AS \"T_diff\" FROM ({LAG})")
def time_diff_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return seq.time_diff(_events(spark, sf), ["user_id"], "ts", ["ts", "event_id"], "seconds").select("event_id", "T_diff")


@query("time_diff_raw", f"SELECT event_id, coalesce(us * 1000, 0)::BIGINT AS \"T_diff\" FROM ({LAG})")
def time_diff_raw(spark: SparkSession, sf: str) -> DataFrame:
    return seq.time_diff(_events(spark, sf), ["user_id"], "ts", ["ts", "event_id"], "raw").select("event_id", "T_diff")


@query("day_count", "SELECT event_id, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0::DOUBLE)::BIGINT AS day_count FROM events")
def day_count(spark: SparkSession, sf: str) -> DataFrame:
    return seq.day_count(_events(spark, sf), ["user_id"], "ts", ["event_id"], fill=False).select("event_id", "day_count")


INTERPOLATED = """n AS (SELECT event_id, user_id, {value} AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {source}),
a AS (SELECT *, last_value(v IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER up AS p0,
  first_value(v IGNORE NULLS) OVER down AS v1, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER down AS p1 FROM n
  WINDOW up AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT event_id, p, CASE WHEN v IS NOT NULL THEN v WHEN p1 IS NULL THEN v0 WHEN p0 IS NOT NULL THEN v0 + (v1 - v0) * (p - p0) / (p1 - p0) END AS v FROM a)"""


@query("interpolate", f"WITH {INTERPOLATED.format(value='CASE WHEN event_id % 7 <> 0 THEN value END', source='events')} SELECT event_id, round(v, 6) AS value FROM i")
def interpolate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return seq.interpolate(rows, ["user_id"], ["event_id"], "value").select("event_id", F.round("value", 6).alias("value"))


DAYS = "(SELECT *, floor((epoch_us(t) - min(epoch_us(t)) OVER (PARTITION BY user_id)) / 86400000000.0::DOUBLE) AS d FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events))"


@query(
    "day_count_interpolated",
    f"WITH {INTERPOLATED.format(value='d', source=DAYS)}, m AS (SELECT p, avg(v) AS mean FROM i GROUP BY p) SELECT event_id, trunc(round(coalesce(v, mean), 9))::BIGINT AS day_count FROM i JOIN m USING (p)",
)
def day_count_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return seq.day_count(rows, ["user_id"], "ts", ["event_id"]).select("event_id", "day_count")


@query(
    "nth_mean_impute",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
    SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY p)), 9) AS value FROM n""",
)
def nth_mean_impute(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return seq.fill_by_position(rows, ["user_id"], ["event_id"], "value").select("event_id", F.round("value", 9).alias("value"))


@query(
    "start_by_key",
    """SELECT o_custkey, arg_min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS o_orderpriority, arg_min(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
)
def start_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return seq.start_by_key(rows, ["o_custkey"], "o_orderstatus", "F", ["o_orderkey"], ["o_orderpriority", "o_totalprice"])


@query(
    "start_by_priority",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate ASC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def start_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return seq.start_by_priority(rows, ["o_custkey"], "o_orderstatus", "P", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "vertical_sequences",
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    e AS (SELECT *, (i = 1 OR i = n) AS edge FROM n WHERE n >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, edge ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '42')), o_orderkey) AS k FROM e)
    SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE n <= 10 OR edge OR k <= 8""",
)
def vertical_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return seq.vertical_sequences(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"], 10, 2).drop("o_orderdate")


def _trial(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_mktsegment")


KEYS, TIME, STATIC, EVENTS = ["o_custkey"], ["o_orderdate", "o_orderkey"], ["c_mktsegment"], ["o_orderstatus", "o_orderpriority"]
T = """t AS (SELECT o_custkey, c_mktsegment, o_orderstatus, o_orderpriority, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
RECENT = f"""{T}, k AS (SELECT *, 0 AS dup FROM t WHERE n > 2 AND (n <= 10 OR i > n - 11) UNION ALL SELECT *, -1 FROM t WHERE n > 10 AND i = 1),
flat AS (SELECT o_custkey, n, any_value(c_mktsegment) || string_agg(',[START_EVENT],' || o_orderstatus || ',' || o_orderpriority, '' ORDER BY dup, i) AS sequence FROM k GROUP BY o_custkey, n)"""


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return seq.recent_sequences(_trial(spark, sf), KEYS, TIME, STATIC, EVENTS, 10, 2)


@query("sequence_recent", f"WITH {RECENT} SELECT o_custkey, sequence, least(n, 10) AS n_events FROM flat")
def sequence_recent(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf).withColumn("sequence", F.array_join("sequence", ","))


@query(
    "sequence_sampled",
    f"""WITH {T}, s AS (SELECT t.*, sample FROM t, range(0, 3) r(sample) WHERE n > 2 AND (n > 10 OR sample = 0)),
    r AS (SELECT *, (i = 1 OR i = n) AS edge, row_number() OVER (PARTITION BY o_custkey, sample, (i = 1 OR i = n) ORDER BY md5(concat_ws(':', o_custkey::VARCHAR, sample::VARCHAR, i::VARCHAR, '42')), i) AS k FROM s),
    f AS (SELECT o_custkey, sample, least(n, 10) AS n_events, string_agg(i::VARCHAR, ',' ORDER BY i) AS picked, any_value(c_mktsegment) || string_agg(',[START_EVENT],' || o_orderstatus || ',' || o_orderpriority, '' ORDER BY i) AS sequence
      FROM r WHERE n <= 10 OR edge OR k <= 8 GROUP BY o_custkey, sample, n)
    SELECT o_custkey, sample, sequence, n_events FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, picked ORDER BY sample) AS d FROM f) WHERE d = 1""",
)
def sequence_sampled(spark: SparkSession, sf: str) -> DataFrame:
    out = seq.sampled_sequences(_trial(spark, sf), KEYS, TIME, STATIC, EVENTS, 10, 2, 3)
    return out.withColumn("sequence", F.array_join("sequence", ","))


@query(
    "sequence_to_table",
    f"WITH {T}, k AS (SELECT *, 0 AS dup FROM t WHERE n > 2 AND (n <= 10 OR i > n - 11) UNION ALL SELECT *, -1 FROM t WHERE n > 10 AND i = 1) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY dup, i)::INTEGER AS position, c_mktsegment, o_orderstatus, o_orderpriority FROM k",
)
def sequence_to_table(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = _recent(spark, sf).withColumn("sequence", seq.wrap(F.col("sequence"), eos=False))
    return seq.sequences_to_table(wrapped, "o_custkey", "sequence", STATIC, EVENTS)


PADDED = f"""{RECENT}, w AS (SELECT o_custkey, '[BOS],' || sequence || ',[EOS]' AS s FROM flat), z AS (SELECT *, len(string_split(s, ',')) AS k FROM w)"""


@query(
    "bos_eos_pad",
    f"WITH {PADDED} SELECT o_custkey, s || repeat(',[PAD]', ((SELECT max(k) FROM z) - k)::INTEGER) AS tokens, k AS n_real FROM z",
)
def bos_eos_pad(spark: SparkSession, sf: str) -> DataFrame:
    padded = seq.pad(_recent(spark, sf).withColumn("tokens", seq.wrap(F.col("sequence"))), "tokens")
    real = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint")
    return padded.select("o_custkey", F.array_join("tokens", ",").alias("tokens"), real.alias("n_real"))


@query(
    "field_mask",
    f"""WITH {PADDED}, x AS (SELECT o_custkey, unnest(string_split(s, ',')) AS t, unnest(range(0, k)) AS i FROM z)
    SELECT o_custkey, string_agg(CASE WHEN t IN ('[BOS]', '[EOS]', '[START_EVENT]') THEN 'SPECIAL' WHEN i = 1 THEN 'c_mktsegment' WHEN (i - 2) % 3 = 1 THEN 'o_orderstatus' ELSE 'o_orderpriority' END, ',' ORDER BY i) AS fields FROM x GROUP BY o_custkey""",
)
def field_mask(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = _recent(spark, sf).withColumn("tokens", seq.wrap(F.col("sequence")))
    return wrapped.select("o_custkey", F.array_join(seq.field_mask(F.col("tokens"), STATIC, EVENTS), ",").alias("fields"))


VOCAB = """special AS (SELECT * FROM (VALUES ('[UNK]', 0), ('[START_EVENT]', 1), ('[PAD]', 2), ('[CLS]', 3), ('[MASK]', 4), ('[BOS]', 5), ('[EOS]', 6), ('[MISSING]', 7)) v(token, id)),
counts AS (SELECT 0 AS f, 'o_orderstatus' AS field, o_orderstatus AS token, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL
  SELECT 1, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority UNION ALL
  SELECT 2, 'size', k::VARCHAR, -k FROM (SELECT unnest(range(1, 51)) AS k)),
vocab AS (SELECT 'SPECIAL' AS field, token, id::BIGINT AS global_id, id::BIGINT AS local_id FROM special UNION ALL
  SELECT field, token, 7 + row_number() OVER (ORDER BY f, n DESC, token), row_number() OVER (PARTITION BY f ORDER BY n DESC, token) - 1 FROM counts)"""


@query("vocabulary", f"WITH {VOCAB} SELECT field, token, global_id, local_id FROM vocab")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_size").alias("size"))
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    both = seq.vocabulary(orders, ["o_orderstatus", "o_orderpriority"])
    sizes = seq.vocabulary(parts, ["size"], ("size",)).where("field = 'size'")
    n = both.agg(F.max("global_id") + 1).first()[0]
    return both.unionByName(sizes.withColumn("global_id", F.col("global_id") - len(seq.SPECIAL_TOKENS) + F.lit(n)))


TOKENS = """words AS (SELECT conv_id, turn, role FROM conversations), vocab AS (SELECT role AS token, 7 + row_number() OVER (ORDER BY count(*) DESC, role) AS id FROM conversations GROUP BY role)"""


def _roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    lists = lists.select("conv_id", F.transform("r", lambda x: x["role"]).alias("tokens"), F.transform("r", lambda x: F.lit("role")).alias("fields"))
    return lists, seq.vocabulary(rows, ["role"])


@query("encode_tokens", f"WITH {TOKENS} SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY turn, role) AS ids FROM words JOIN vocab ON role = token GROUP BY conv_id")
def encode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lists, vocab = _roles(spark, sf)
    ids = seq.encode(lists, ["conv_id"], "tokens", "fields", vocab)
    return ids.select("conv_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("decode_tokens", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS tokens FROM conversations GROUP BY conv_id")
def decode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lists, vocab = _roles(spark, sf)
    decoded = seq.decode(seq.encode(lists, ["conv_id"], "tokens", "fields", vocab), ["conv_id"], "ids", vocab)
    return decoded.withColumn("tokens", F.array_join("tokens", ","))


@query(
    "tokenize_pipeline",
    f"""WITH {PADDED}, x AS (SELECT o_custkey, unnest(string_split(s || repeat(',[PAD]', ((SELECT max(k) FROM z) - k)::INTEGER), ',')) AS t, unnest(range(0, (SELECT max(k) FROM z))) AS i FROM z),
    special AS (SELECT * FROM (VALUES ('[UNK]', 0), ('[START_EVENT]', 1), ('[PAD]', 2), ('[CLS]', 3), ('[MASK]', 4), ('[BOS]', 5), ('[EOS]', 6), ('[MISSING]', 7)) v(token, id)),
    joined AS (SELECT c_mktsegment, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
    counts AS (SELECT 0 AS f, 1 AS place, c_mktsegment AS token, count(*) AS n FROM joined GROUP BY c_mktsegment UNION ALL SELECT 1, 2, o_orderstatus, count(*) FROM joined GROUP BY o_orderstatus UNION ALL SELECT 2, 3, o_orderpriority, count(*) FROM joined GROUP BY o_orderpriority),
    vocab AS (SELECT f, token, 7 + row_number() OVER (ORDER BY f, n DESC, token) AS id FROM counts)
    SELECT o_custkey, string_agg(coalesce(s.id, v.id)::VARCHAR, ',' ORDER BY i) AS ids, count(*) FILTER (WHERE t <> '[PAD]') AS n_real
    FROM x LEFT JOIN special s ON s.token = t LEFT JOIN vocab v ON s.token IS NULL AND v.token = t AND v.f = CASE WHEN i = 1 THEN 0 WHEN (i - 2) % 3 = 1 THEN 1 ELSE 2 END GROUP BY o_custkey""",
)
def tokenize_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    out = seq.tokenise(_trial(spark, sf), KEYS, TIME, STATIC, EVENTS, 10, 2)
    real = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint")
    return out.select("o_custkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), real.alias("n_real"))


@query(
    "start_sequences",
    """WITH f AS (SELECT o_custkey, c_mktsegment, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_custkey, '[BOS],' || c_mktsegment || ',[START_EVENT],' || o_orderstatus || ',' || o_orderpriority AS tokens FROM f WHERE r = 1""",
)
def start_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """A mark, the static columns and the first event, to be continued by a generator."""
    first = seq.start_by_priority(_trial(spark, sf), KEYS, "o_orderstatus", "none", "o_orderdate", ["o_orderkey"])
    flat = seq.recent_sequences(first, KEYS, TIME, STATIC, EVENTS, 10, 0)
    return flat.select("o_custkey", F.array_join(seq.wrap(F.col("sequence"), eos=False), ",").alias("tokens"))
