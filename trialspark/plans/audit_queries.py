"""Queries over disclosure risk, the trust index and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import audit, models, privacy, stats, subjects
from trialspark.registry import query, table


def _side(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_custkey") % 2 == parity).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


HALVES = """real AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 0), synth AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 1)"""
RS = f"""{HALVES}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM real) WHERE k = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM synth) WHERE k = 1),
p AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM real)::DOUBLE AS p FROM real GROUP BY 1),
m AS (SELECT r.c_nationkey, ((1 - p) * (r.c_mktsegment = s.c_mktsegment)::INTEGER > sqrt(p * (1 - p)))::INTEGER AS rs FROM r JOIN s USING (c_nationkey) JOIN p ON p.c_mktsegment = r.c_mktsegment),
scored AS (SELECT real.*, m.rs AS "R_s" FROM real LEFT JOIN m USING (c_nationkey))"""


@query("rs_nominal", f"WITH {RS} SELECT * FROM scored")
def rs_nominal(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.rs_nominal(_side(spark, sf, 0), _side(spark, sf, 1), ["c_nationkey"], "c_mktsegment", ["c_custkey"])


@query(
    "disclosure_risk",
    f"""WITH {RS}, f AS (SELECT c_nationkey, count(*) AS f_s FROM real GROUP BY 1), g AS (SELECT c_nationkey, count(*) AS g_s FROM synth GROUP BY 1)
    SELECT 'c_mktsegment' AS column_name, greatest(round_even(sum(coalesce("R_s", 0) / f_s::DOUBLE) FILTER (WHERE g_s IS NOT NULL) / (SELECT count(*) FROM real), 4), round_even(sum(coalesce("R_s", 0) / g_s::DOUBLE) / (SELECT count(*) FROM synth), 4)) AS risk
    FROM scored LEFT JOIN f USING (c_nationkey) LEFT JOIN g USING (c_nationkey)""",
)
def disclosure_risk(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = _side(spark, sf, 0), _side(spark, sf, 1)
    scored = privacy.rs_nominal(privacy.equivalence_classes(real, synth, ["c_nationkey"]), synth, ["c_nationkey"], "c_mktsegment", ["c_custkey"], "Rs_c_mktsegment")
    return privacy.disclosure_risk(scored, real.count(), synth.count(), ["c_mktsegment"])


BREAKS = [0.0, 2500.0, 5000.0]


@query(
    "rs_continuous",
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_acctbal AS y FROM customer WHERE c_custkey % 2 = 1),
    n AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) AS n), rr AS (SELECT r.* FROM r, n WHERE _row < n),
    c AS (SELECT *, (c_acctbal > 0)::INTEGER + (c_acctbal > 2500)::INTEGER + (c_acctbal > 5000)::INTEGER AS k FROM rr), sizes AS (SELECT k, count(*) AS cs FROM c GROUP BY k),
    m AS (SELECT median(c_acctbal) AS m, count(*) AS t FROM rr), a AS (SELECT 1.48::DOUBLE * median(abs(c_acctbal - m)) AS mad FROM rr, m)
    SELECT c_custkey, (cs / t::DOUBLE * abs(c_acctbal - y) < mad)::INTEGER AS "R_s" FROM c JOIN sizes USING (k) JOIN s USING (_row), m, a""",
)
def rs_continuous(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = subjects.same_size(_side(spark, sf, 0), _side(spark, sf, 1), ["c_custkey"], ["c_custkey"])
    return privacy.rs_continuous(real, synth, "c_acctbal", BREAKS).select("c_custkey", "R_s")


@query("jenks")
def jenks(spark: SparkSession, sf: str) -> DataFrame:
    k, breaks, fit = privacy.jenks(table(spark, sf, "lineitem"), "l_quantity")
    return spark.createDataFrame([(k, breaks, fit)], "k int, breaks array<double>, fit double")


RUNS = "SELECT o_custkey % 5 AS trial, o_totalprice / 1000 AS score FROM orders"


@query("seed_stats", f"SELECT trial, round(avg(score), 6) AS mean, round(var_pop(score), 4) AS variance FROM ({RUNS}) GROUP BY trial")
def seed_stats(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("trial"), (F.col("o_totalprice") / 1000).alias("score"))
    return stats.seed_statistics(runs, ["trial"], "score").select("trial", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


#: A table of metrics to aggregate: nations are data sets, segments are metrics of two dimensions.
METRICS = """m AS (SELECT c_nationkey AS dataset_id, c_mktsegment AS metric, CASE WHEN c_mktsegment < 'C' THEN 'fidelity' ELSE 'privacy' END AS dimension, avg(c_acctbal) * any_value(CASE WHEN c_mktsegment < 'C' THEN 1 ELSE -1 END) AS aligned FROM customer GROUP BY c_nationkey, c_mktsegment)"""


@query(
    "trust_index",
    f"""WITH {METRICS}, u AS (SELECT a.dataset_id, a.dimension, a.metric, avg((b.aligned <= a.aligned)::INTEGER) AS u FROM m a JOIN m b USING (dimension, metric) GROUP BY ALL),
    s AS (SELECT dataset_id, dimension, exp(avg(ln(greatest(u, 2.220446049250313e-16)))) AS score FROM u GROUP BY ALL)
    SELECT dataset_id, round(max(score) FILTER (WHERE dimension = 'fidelity'), 6) AS fidelity, round(max(score) FILTER (WHERE dimension = 'privacy'), 6) AS privacy,
      round(exp(sum(CASE dimension WHEN 'fidelity' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * ln(score))), 6) AS trust_index FROM s GROUP BY dataset_id""",
)
def trust_index(spark: SparkSession, sf: str) -> DataFrame:
    fidelity = F.col("c_mktsegment") < "C"
    metrics = (
        table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("dataset_id"), F.col("c_mktsegment").alias("metric"), F.when(fidelity, "fidelity").otherwise("privacy").alias("dimension"))
        .agg(F.avg("c_acctbal").alias("value"))
        .withColumn("polarity", F.when(F.col("metric") < "C", 1).otherwise(-1))
    )
    metrics = audit.aligned(metrics)
    scores = audit.aggregate_dimensions(audit.normalise(metrics, metrics, ["dimension", "metric"]), {"fidelity": 0.6, "privacy": 0.4})
    return scores.select("dataset_id", *[F.round(c, 6).alias(c) for c in ("fidelity", "privacy", "trust_index")])


def registry() -> audit.EvaluatorRegistry:
    out = audit.EvaluatorRegistry()
    out.add("kl", lambda r, s: audit.wide_to_long(stats.kl_divergence(r, s, "c_mktsegment")), {"kl": -1})
    out.add("jsd", lambda r, s: audit.wide_to_long(stats.js_distance(r, s, "c_mktsegment")), {"js_distance": -1})
    out.add("wasserstein", lambda r, s: audit.wide_to_long(stats.wasserstein_1d(r, s, "c_acctbal")), {"wasserstein": -1})
    return out


@query("batch_eval")
def batch_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Real rows blended into synthetic ones at several shares, each blend evaluated."""
    real, synth = _side(spark, sf, 0), _side(spark, sf, 1)
    blends = subjects.blend_grid(real, synth, ["c_custkey"], [0.0, 0.5, 1.0]).cache()
    datasets = {str(k): blends.where(F.col("dataset_id") == k).drop("dataset_id", "fraction") for k in range(3)}
    return audit.aligned(registry().evaluate(real, datasets))


@query("copula_sample")
def copula_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return models.GaussianCopula.fit(rows, ["l_quantity", "l_extendedprice"]).sample(spark, 1000)


@query("mixture_sample")
def mixture_sample(spark: SparkSession, sf: str) -> DataFrame:
    return models.GaussianMixture(k=3, max_iter=20).fit(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]).sample(spark, 1000)


@query(
    "transition_shares",
    """WITH s AS (SELECT user_id, coalesce(lag(event_type) OVER w, '[BOS]') AS event, event_type AS following, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT event, following, count(*) AS n FROM (SELECT event, following FROM s UNION ALL SELECT following, '[EOS]' FROM s WHERE nxt IS NULL) GROUP BY ALL)
    SELECT event, following, round(n / sum(n) OVER (PARTITION BY event), 9) AS share FROM c""",
)
def transition_shares(spark: SparkSession, sf: str) -> DataFrame:
    return models.transition_shares(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").withColumn("share", F.round("share", 9))
