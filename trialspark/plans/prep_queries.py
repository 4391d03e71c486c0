"""Queries over sources, projections and preparation."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.expressions import md5_rank_key
from trialspark.operators import audit, merge, models, prep, stats
from trialspark.registry import query, table
from trialspark.sources import files
from trialspark.storage import scratch


@query("scan_project", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_file(spark, f"{sf}/customer.parquet", ["C_CustKey", "C_MktSegment", "C_AcctBal"])


@query("csv_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written to the shared folder."""
    path = scratch(spark, "suppliers") + ".csv"
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    suppliers.write.csv(path, header=True)
    return files.read_file(spark, path, ["s_suppkey", "s_name", "s_acctbal"], "S_SUPPKEY bigint, S_NAME string, S_ACCTBAL double")


@query(
    "load_pipeline",
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS answered
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def load_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    loaded = files.batch_load(spark, sf, {"customer.parquet": ["c_custkey", "c_mktsegment"], "orders.parquet": ["o_custkey", "o_orderkey", "o_totalprice"], "absent.parquet": None})
    events = loaded["orders"].withColumnRenamed("o_custkey", "c_custkey")
    answer = F.when(F.col("o_orderkey") % 3 == 0, "Yes").when(F.col("o_orderkey") % 3 == 1, "No").otherwise("")
    merged = merge.sequential_merge({"customer": loaded["customer"], "orders": events.withColumn("answered", answer)}, ["c_custkey"])
    return prep.optimise_types(merged, False)


RUNS = "SELECT s_suppkey AS run_id, s_acctbal AS trust_index, s_suppkey % 3 <> 0 AS has_artifact FROM supplier"


@query("best_run_topk", f"SELECT run_id, trust_index FROM ({RUNS}) WHERE has_artifact ORDER BY trust_index DESC NULLS LAST, run_id LIMIT 1")
def best_run_topk(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").alias("trust_index"), (F.col("s_suppkey") % 3 != 0).alias("has_artifact"))
    return audit.best_run(runs, "trust_index", "has_artifact").select("run_id", "trust_index")


@query("toy_grid")
def toy_grid(spark: SparkSession, sf: str) -> DataFrame:
    return models.toy_grid(spark)


@query(
    "subject_profile",
    """SELECT 'value' AS column_name, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM events WHERE user_id = 7
    UNION ALL SELECT 'event_id', count(event_id), round(avg(event_id), 6), min(event_id)::DOUBLE, max(event_id)::DOUBLE FROM events WHERE user_id = 7""",
)
def subject_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.profile(table(spark, sf, "events").where("user_id = 7"), ["value", "event_id"]).withColumn("mean", F.round("mean", 6))


@query("project_static", "SELECT c_mktsegment, c_nationkey FROM customer")
def project_static(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey")


TYPED = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer, {date} AS day FROM orders"""


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("o_orderkey") % 3 == 0, "Yes").when(F.col("o_orderkey") % 3 == 1, "No").otherwise("")
    day = F.when(F.col("o_orderkey") % 13 == 0, "missing").otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", answer.alias("answer"), day.alias("day"))


@query("dtype_optimize", TYPED.format(date="CASE WHEN o_orderkey % 13 <> 0 THEN epoch(date_trunc('day', o_orderdate))::DOUBLE END"))
def dtype_optimize(spark: SparkSession, sf: str) -> DataFrame:
    return prep.optimise_types(_typed(spark, sf), True)


@query(
    "obj2bool",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, o_orderkey % 2 = 0 AS b, o_orderkey % 5 < 2 AS c, o_orderkey % 7 = 0 AS d,
      CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 4 = 0 END AS e, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS f, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'None' END AS g FROM orders""",
)
def obj2bool(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise(" ").alias("a"), either(k % 2 == 0, "YES", "NO").alias("b"), either(k % 5 < 2, "TRUE", "FALSE").alias("c"),
        either(k % 7 == 0, "true", "false").alias("d"), F.when(k % 11 > 0, either(k % 4 == 0, "1", "0")).alias("e"), either(k % 2 == 0, "yes", "no").alias("f"), either(k % 2 == 0, "Yes", "None").alias("g"),
    )
    return prep.BooleanMapper.fit(df).transform(df)


@query("hidden_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '' END AS answer, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def hidden_dates(spark: SparkSession, sf: str) -> DataFrame:
    df = _typed(spark, sf)
    return prep.HiddenDates.fit(df).transform(df).withColumn("day", F.col("day").cast("string"))


@query("date_to_unix", "SELECT event_id, epoch(date_trunc('day', ts))::DOUBLE AS ts FROM events")
def date_to_unix(spark: SparkSession, sf: str) -> DataFrame:
    return prep.date_to_unix(table(spark, sf, "events").select("event_id", "ts"), ["ts"])


@query("unix_to_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts FROM events")
def unix_to_date(spark: SparkSession, sf: str) -> DataFrame:
    unix = prep.date_to_unix(table(spark, sf, "events").select("event_id", "ts"), ["ts"])
    return prep.unix_to_date(unix, ["ts"]).withColumn("ts", F.col("ts").cast("string"))


@query("cast_columns", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0)::BIGINT AS l_extendedprice FROM lineitem")
def cast_columns(spark: SparkSession, sf: str) -> DataFrame:
    return prep.cast_columns(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], "bigint")


@query("count_round", "SELECT event_id, round_even(value, 0)::BIGINT AS value FROM events")
def count_round(spark: SparkSession, sf: str) -> DataFrame:
    return prep.round_counts(table(spark, sf, "events").select("event_id", "value"), ["value"])


@query("nan_insert", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events")
def nan_insert(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_type")
    return prep.copy_nulls(df, "value", "event_type")


@query(
    "replace_contains",
    """SELECT p_partkey, CASE WHEN regexp_matches(t, 'plated') THEN 'metal' ELSE t END AS p_type FROM (
      SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^[A-M]') THEN 'plated early' ELSE p_type END AS t FROM part)""",
)
def replace_contains(spark: SparkSession, sf: str) -> DataFrame:
    return prep.replace_matching(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", {"^[A-M]": "plated early", "plated": "metal"})


@query("merge_cols", "SELECT c_custkey, concat_ws('_', c_mktsegment, c_nationkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN 'nan' ELSE c_name END) AS merged FROM customer")
def merge_cols(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"))
    return prep.merge_to_string(df, ["c_mktsegment", "c_nationkey", "c_name"], "merged")


@query("single_key", "SELECT o_custkey::VARCHAR || '_' || o_orderkey::VARCHAR AS unique_id, o_orderstatus FROM orders")
def single_key(spark: SparkSession, sf: str) -> DataFrame:
    return prep.single_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderkey"])


@query(
    "postprocess",
    """SELECT o_orderkey, round_even(o_totalprice, 0)::BIGINT AS o_totalprice, o_orderstatus, 0 AS visit FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)""",
)
def postprocess(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return prep.restore_types(df, ["o_totalprice"], ["o_orderdate"], {"visit": 0}, 100, "o_orderkey")


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type"))
    return e.select("event_id", text.alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("value") > 50).alias("high"))


GAPS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 5 <> 0 THEN value > 50 END AS high FROM events"""


@query("impute_mean", f"WITH g AS ({GAPS}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value FROM g")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = _gaps(spark, sf)
    return prep.Imputer.fit(df, exclude=("event_id",)).transform(df).select("event_id", F.round("value", 6).alias("value"))


@query("impute_mode", f"WITH g AS ({GAPS}) SELECT event_id, coalesce(high, (SELECT high FROM g WHERE high IS NOT NULL GROUP BY high ORDER BY count(*) DESC, high LIMIT 1)) AS high FROM g")
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    df = _gaps(spark, sf)
    return prep.Imputer.fit(df, exclude=("event_id",)).transform(df).select("event_id", "high")


@query("impute_const", f"WITH g AS ({GAPS}) SELECT event_id, CASE WHEN event_type IS NULL OR regexp_full_match(event_type, '\\s*') THEN 'missing' ELSE event_type END AS event_type FROM g")
def impute_const(spark: SparkSession, sf: str) -> DataFrame:
    df = _gaps(spark, sf)
    return prep.Imputer.fit(df, exclude=("event_id",)).transform(df).select("event_id", "event_type")



@query(
    "ohe",
    """SELECT c_custkey, s AS segment, CASE WHEN c_mktsegment = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag
    FROM customer CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)""",
)
def ohe(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    encoder = prep.Encoder.fit(df, exclude=("c_custkey",))
    wide = encoder.transform(df, keep=("c_custkey",))
    long = wide.unpivot(["c_custkey"], [F.col(f"`{c}`") for c in encoder.output_columns], "segment", "flag")
    return long.withColumn("segment", F.expr("substring(segment, length('c_mktsegment_') + 1)"))


@query("minmax_scale", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 9) AS c_acctbal FROM customer")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return prep.Encoder.fit(df, exclude=("c_custkey",)).transform(df, keep=("c_custkey",)).withColumn("c_acctbal", F.round("c_acctbal", 9))


@query("encoder_roundtrip", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 4) AS c_acctbal, c_acctbal > 0 AS positive FROM customer")
def encoder_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_acctbal") > 0).alias("positive"))
    encoder = prep.Encoder.fit(df, exclude=("c_custkey",))
    return encoder.inverse(encoder.transform(df, keep=("c_custkey",)), keep=("c_custkey",)).withColumn("c_acctbal", F.round("c_acctbal", 4))


UNIFORM = """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
edges AS (SELECT lo + (hi - lo) * k / 7 AS edge FROM e, range(1, 7) r(k)),
binned AS (SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM edges WHERE edge <= l_quantity) AS bin FROM lineitem)"""


@query("bin_uniform", f"{UNIFORM} SELECT l_orderkey, l_linenumber, bin AS l_quantity FROM binned")
def bin_uniform(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return prep.Binner.fit(df, ["l_quantity"], 7).transform(df)


@query("bin_inverse", f"{UNIFORM} SELECT l_orderkey, l_linenumber, round(lo + (hi - lo) * (bin + 0.5::DOUBLE) / 7, 6) AS l_quantity FROM binned, e")
def bin_inverse(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    binner = prep.Binner.fit(df, ["l_quantity"], 7)
    return binner.inverse(binner.transform(df)).withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "bin_quantile",
    """WITH q AS (SELECT DISTINCT unnest(quantile_cont(l_extendedprice, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS edge FROM lineitem),
    inner_edges AS (SELECT edge FROM q WHERE edge > (SELECT min(edge) FROM q) AND edge < (SELECT max(edge) FROM q))
    SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM inner_edges WHERE edge <= l_extendedprice) AS l_extendedprice FROM lineitem""",
)
def bin_quantile(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return prep.Binner.fit(df, ["l_extendedprice"], 5, "quantile").transform(df)


@query("bin_kmeans")
def bin_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return prep.Binner.fit(df, ["l_quantity"], 5, "kmeans").transform(df)


@query("md5_rank", "SELECT o_orderkey, md5(concat_ws(':', o_orderkey::VARCHAR, '42')) AS rank_key FROM orders")
def md5_rank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", md5_rank_key(42, "o_orderkey").alias("rank_key"))
