"""Queries over joins and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import merge, privacy, stats, subjects
from trialspark.registry import query, table

SECOND = "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0"
FIRST = "SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders"


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 23 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")


def _second(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).when(F.col("o_orderkey") % 19 == 0, None).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").where("o_orderkey % 4 <> 0").select("o_orderkey", price.alias("o_totalprice"), "o_orderstatus")


MERGED = f"SELECT a.o_orderkey, a.o_totalprice, a.o_orderstatus, b.o_totalprice AS o_totalprice_right, b.o_orderstatus AS o_orderstatus_right FROM ({FIRST}) a LEFT JOIN ({SECOND}) b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey"


@query("pair_merge", MERGED)
def pair_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.pair_merge(_first(spark, sf), _second(spark, sf), ["o_orderkey"])


@query(
    "merge_discrepancies",
    f"""WITH m AS ({MERGED})
    SELECT 'o_totalprice' AS column_name, count(*) FILTER (WHERE NOT coalesce(o_totalprice = o_totalprice_right, false)) AS n_different FROM m
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE NOT coalesce(o_orderstatus = o_orderstatus_right, false)) FROM m""",
)
def merge_discrepancies(spark: SparkSession, sf: str) -> DataFrame:
    return merge.discrepancies(pair_merge(spark, sf), ["o_totalprice", "o_orderstatus"])


@query("reconcile_cols", f"WITH m AS ({MERGED}) SELECT o_orderkey, coalesce(o_totalprice, o_totalprice_right) AS o_totalprice, coalesce(o_totalprice_right, o_totalprice) AS o_totalprice_right, o_orderstatus FROM m")
def reconcile_cols(spark: SparkSession, sf: str) -> DataFrame:
    return merge.reconcile(pair_merge(spark, sf), ["o_totalprice", "o_orderstatus"])


@query(
    "sequential_merge",
    """SELECT n_nationkey AS nationkey, n_name AS name, r_name AS name_region, n_regionkey AS regionkey, coalesce(s_name, n_name) AS name_supplier, s_suppkey FROM nation
    LEFT JOIN (SELECT n_nationkey AS k, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r ON n_nationkey = r.k LEFT JOIN supplier ON s_nationkey = n_nationkey""",
)
def sequential_merge(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    first = nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    second = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("nationkey"), F.col("r_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    third = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), "s_suppkey")
    return merge.sequential_merge({"nation": first, "region": second, "supplier": third}, ["nationkey"])


def _customers(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_custkey") % 2 == parity).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


HALVES = """real AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 0),
synth AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 1)"""


@query(
    "qid_match",
    f"""WITH {HALVES},
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM real) WHERE k = 1),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM synth) WHERE k = 1)
    SELECT r.c_custkey, r.c_nationkey, r.c_mktsegment, r.c_acctbal, s.c_custkey AS c_custkey_synth, s.c_mktsegment AS c_mktsegment_synth, s.c_acctbal AS c_acctbal_synth
    FROM r JOIN s ON r.c_nationkey IS NOT DISTINCT FROM s.c_nationkey""",
)
def qid_match(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.qid_matches(_customers(spark, sf, 0), _customers(spark, sf, 1), ["c_nationkey"], ["c_custkey"])


@query(
    "equivalence_classes",
    f"""WITH {HALVES}, f AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM real GROUP BY ALL), g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM synth GROUP BY ALL)
    SELECT real.*, coalesce(f.n, 0) AS f_s, coalesce(g.n, 0) AS f_synth, (f.n IS NOT NULL AND g.n IS NOT NULL)::INTEGER AS "I_s"
    FROM real LEFT JOIN f USING (c_nationkey, c_mktsegment) LEFT JOIN g USING (c_nationkey, c_mktsegment)""",
)
def equivalence_classes(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.equivalence_classes(_customers(spark, sf, 0), _customers(spark, sf, 1), ["c_nationkey", "c_mktsegment"])


@query(
    "common_values",
    """SELECT 'orders' AS left_name, 'customer' AS right_name, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS n_common
    UNION ALL SELECT 'orders', 'supplier', (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier))
    UNION ALL SELECT 'customer', 'supplier', (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier))""",
)
def common_values(spark: SparkSession, sf: str) -> DataFrame:
    tables = {
        "orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("id")),
        "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")),
    }
    return merge.common_values(tables, "id")


@query("common_columns", "SELECT 'a' AS left_name, 'b' AS right_name, 'o_orderkey,o_totalprice,o_orderstatus' AS columns UNION ALL SELECT 'a', 'c', '' UNION ALL SELECT 'b', 'c', ''")
def common_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = merge.common_columns({"a": _first(spark, sf), "b": _second(spark, sf), "c": table(spark, sf, "region")})
    return spark.createDataFrame([(a, b, ",".join(c)) for a, b, c in found], "left_name string, right_name string, columns string")


ORDINALS = """r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, * FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, * FROM customer WHERE c_custkey % 2 = 1)"""


@query("positional_diff", f"WITH {ORDINALS} SELECT r._row, r.c_custkey, s.c_custkey AS c_custkey_synth, round(abs(r.c_acctbal - s.c_acctbal), 6) AS difference FROM r JOIN s USING (_row)")
def positional_diff(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = subjects.same_size(_customers(spark, sf, 0), _customers(spark, sf, 1), ["c_custkey"], ["c_custkey"])
    paired = merge.zip_rows(real, synth)
    return paired.select("_row", "c_custkey", "c_custkey_synth", F.round(F.abs(F.col("c_acctbal") - F.col("c_acctbal_synth")), 6).alias("difference"))


@query("qid_class_sizes", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def qid_class_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.value_counts(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("distinct_subjects", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def distinct_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count_distinct("o_custkey").alias("n"))


@query("union_all", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return stats.union_all([s, c, s])
