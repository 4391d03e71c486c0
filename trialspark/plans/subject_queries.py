"""Queries over subjects, splits, samples and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import subjects
from trialspark.registry import query, table

TRIAL = "SELECT o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"
COLUMNS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey"]


def _trial(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_custkey", *COLUMNS)


STATIC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_and(n = 1) AS is_static FROM (SELECT o_custkey, count(DISTINCT {c}) AS n FROM t GROUP BY o_custkey)" for c in COLUMNS)
CARDINALITY = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_values FROM t" for c in COLUMNS)


@query("static_columns", f"WITH t AS ({TRIAL}) {STATIC}")
def static_columns(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.static_columns(_trial(spark, sf), ["o_custkey"], COLUMNS)


@query("static_cardinality", f"WITH t AS ({TRIAL}), s AS ({STATIC}), c AS ({CARDINALITY}) SELECT column_name, n_values FROM c JOIN s USING (column_name) WHERE is_static")
def static_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.static_cardinality(_trial(spark, sf), ["o_custkey"], COLUMNS)


@query("static_to_cat", "SELECT o_orderkey, c_nationkey::VARCHAR AS c_nationkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def static_to_cat(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_custkey", "o_orderkey", "c_nationkey", "o_totalprice")
    static = [r["column_name"] for r in subjects.static_columns(rows, ["o_custkey"], ["c_nationkey", "o_totalprice"]).where("is_static").collect()]
    return rows.withColumns({c: F.col(c).cast("string") for c in static}).drop("o_custkey")


@query("drop_singletons", "SELECT event_id, user_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, hour(ts)) AS n FROM events) WHERE n > 1")
def drop_singletons(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", F.concat_ws(":", F.col("user_id").cast("string"), F.hour(F.col("ts")).cast("string")).alias("slot"))
    return subjects.drop_singletons(rows, "slot").select("event_id", "user_id")


SPLIT = """ids AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_custkey::VARCHAR, '42')), o_custkey) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))"""


@query("grouped_split", f"WITH {SPLIT} SELECT o_orderkey, o_custkey, CASE WHEN k < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM orders JOIN ids USING (o_custkey)")
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = subjects.grouped_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 0.2, 42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "three_way_split",
    """SELECT o_orderkey, CASE WHEN k < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN k < trunc(n * 0.7::DOUBLE) + trunc(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '7')), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)""",
)
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.three_way_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.7, 0.2, 7)


@query(
    "ensure_same_size",
    """WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _row, s_suppkey AS id FROM supplier), s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_custkey AS id FROM customer),
    n AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) AS n) SELECT 'real' AS side, _row, id FROM r, n WHERE _row < n UNION ALL SELECT 'synth', _row, id FROM s, n WHERE _row < n""",
)
def ensure_same_size(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    a, b = subjects.same_size(a, b, ["id"], ["id"])
    return a.select(F.lit("real").alias("side"), "_row", "id").unionByName(b.select(F.lit("synth").alias("side"), "_row", "id"))


def _blend_sql(fractions: str) -> str:
    return f"""WITH f AS (SELECT * FROM (VALUES {fractions}) v(dataset_id, fraction)),
    r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, 'r0')), o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 2 = 0),
    s AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, 's0')), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders WHERE o_orderkey % 2 = 1),
    m AS (SELECT max(n) AS n FROM s)
    SELECT dataset_id, fraction, o_orderkey, o_totalprice FROM f, m, r WHERE k < trunc(m.n * fraction)
    UNION ALL SELECT dataset_id, fraction, o_orderkey, o_totalprice FROM f, s WHERE k >= trunc(s.n * fraction)"""


def _parity(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == parity).select("o_orderkey", "o_totalprice")


@query("mix_datasets", f"SELECT o_orderkey, o_totalprice FROM ({_blend_sql('(0, 0.3::DOUBLE)')})")
def mix_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.mix(_parity(spark, sf, 0), _parity(spark, sf, 1), ["o_orderkey"], 0.3)


@query("blend_grid", _blend_sql("(0, 0.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)"))
def blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.blend_grid(_parity(spark, sf, 0), _parity(spark, sf, 1), ["o_orderkey"], [0.0, 0.1, 0.5, 1.0])


@query(
    "assign_unique_ids",
    """WITH one AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority), o_orderpriority) AS n FROM one)
    SELECT o_custkey, o_orderpriority, o_orderkey, (CASE WHEN g < 1000 THEN lpad(g::VARCHAR, 3, '0') ELSE g::VARCHAR END) || '-' || lpad(n::VARCHAR, 3, '0') AS unique_id
    FROM o JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS g FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)""",
)
def assign_unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    return subjects.assign_unique_ids(rows, ["o_custkey"], "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders")
def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.row_ids(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


@query("assign_ids_by_grouping")
def assign_ids_by_grouping(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return subjects.assign_ids_by_grouping(rows, ["c_nationkey", "c_mktsegment"], ["c_custkey"], {1: 0.5, 2: 0.3, 4: 0.2}, ["a", "b", "c"], 3)
