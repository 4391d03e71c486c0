"""Queries over column statistics and two-sample statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.expressions import kernel
from trialspark.operators import mmd as tests
from trialspark.operators import stats, twosample
from trialspark.registry import query, table


def _half(spark: SparkSession, sf: str, name: str, key: str, parity: int) -> DataFrame:
    return table(spark, sf, name).where(F.col(key) % 2 == parity)


def _orders(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return _half(spark, sf, "orders", "o_orderkey", parity)


def _blocks(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return twosample.blocks(_half(spark, sf, "embeddings", "vec_id", parity), "vec_id", "embedding")


@query("mad", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders) SELECT round(1.48::DOUBLE * median(abs(o_totalprice - m)), 6) AS mad FROM orders, m")
def mad(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mad(table(spark, sf, "orders"), "o_totalprice").select(F.round("mad", 6).alias("mad"))


@query(
    "histogram",
    "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT least(floor((l_quantity - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, "lineitem"), "l_quantity")


@query("ecdf_norm", "SELECT DISTINCT s.o_totalprice AS point, round((SELECT count(*) FROM orders r WHERE r.o_orderkey % 2 = 0 AND r.o_totalprice <= s.o_totalprice) / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)::DOUBLE, 9) AS ecdf FROM orders s WHERE o_orderkey % 2 = 1")
def ecdf_norm(spark: SparkSession, sf: str) -> DataFrame:
    points = _orders(spark, sf, 1).select(F.col("o_totalprice").alias("point"))
    return stats.ecdf(_orders(spark, sf, 0), "o_totalprice", points, "point").withColumn("ecdf", F.round("ecdf", 9))


AUTO = """SELECT o_orderkey % 2 AS side, o_custkey, covar_samp(x, y) / (sqrt(var_samp(CASE WHEN y IS NOT NULL THEN x END)) * sqrt(var_samp(y))) AS r FROM (
  SELECT o_orderkey, o_custkey, o_totalprice AS x, lag(o_totalprice) OVER (PARTITION BY o_orderkey % 2, o_custkey ORDER BY o_orderdate, o_orderkey) AS y FROM orders) GROUP BY ALL"""
AUTO_MEAN = f"SELECT side, avg(r) AS value FROM ({AUTO}) WHERE r IS NOT NULL AND NOT isnan(r) AND NOT isinf(r) GROUP BY side"


def _auto(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return stats.autocorrelation(_orders(spark, sf, parity), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


@query("autocorr", f"SELECT 'o_totalprice' AS column_name, round(value, 6) AS value FROM ({AUTO_MEAN}) WHERE side = 0")
def autocorr(spark: SparkSession, sf: str) -> DataFrame:
    return _auto(spark, sf, 0).withColumn("value", F.round("value", 6))


@query("autocorr_mse", f"SELECT round(pow(max(value) - min(value), 2), 6) AS mse FROM ({AUTO_MEAN})")
def autocorr_mse(spark: SparkSession, sf: str) -> DataFrame:
    return stats.vector_mse(_auto(spark, sf, 0), _auto(spark, sf, 1)).select(F.round("mse", 6).alias("mse"))


CROSS = """SELECT l_linenumber % 2 AS side, avg(r) AS value FROM (SELECT l_linenumber, l_suppkey, r FROM (
  SELECT l_linenumber % 2 AS l_linenumber, l_suppkey, covar_samp(l_quantity, l_extendedprice) / (sqrt(var_samp(l_quantity)) * sqrt(var_samp(l_extendedprice))) AS r FROM lineitem GROUP BY ALL))
  WHERE r IS NOT NULL AND NOT isnan(r) AND NOT isinf(r) GROUP BY 1"""


def _cross(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    return stats.cross_correlation(_half(spark, sf, "lineitem", "l_linenumber", parity), ["l_suppkey"], [("l_quantity", "l_extendedprice")])


@query("crosscorr", f"SELECT 'l_quantity|l_extendedprice' AS column_name, round(value, 6) AS value FROM ({CROSS}) WHERE side = 0")
def crosscorr(spark: SparkSession, sf: str) -> DataFrame:
    return _cross(spark, sf, 0).withColumn("value", F.round("value", 6))


@query("crosscorr_mse", f"SELECT round(pow(max(value) - min(value), 2), 8) AS mse FROM ({CROSS})")
def crosscorr_mse(spark: SparkSession, sf: str) -> DataFrame:
    return stats.vector_mse(_cross(spark, sf, 0), _cross(spark, sf, 1)).select(F.round("mse", 8).alias("mse"))


LONG = "(SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings)"


@query("mean_vector", f"SELECT i, round(avg(x), 6) AS mean FROM {LONG} GROUP BY i")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_vector(table(spark, sf, "embeddings"), "embedding").withColumn("mean", F.round("mean", 6))


@query("cov_matrix", f"SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM {LONG} a JOIN {LONG} b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i")
def cov_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.covariance(table(spark, sf, "embeddings"), "embedding").withColumn("cov", F.round("cov", 6))


@query("frechet")
def frechet(spark: SparkSession, sf: str) -> DataFrame:
    value = stats.frechet_distance(_half(spark, sf, "embeddings", "vec_id", 0), _half(spark, sf, "embeddings", "vec_id", 1), "embedding")
    return spark.createDataFrame([(value,)], "frechet double")


PAIRS = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 2 AS side FROM embeddings),
d AS (SELECT a.id, b.id AS id2, a.side, b.side AS side2, list_distance(a.v, b.v) AS d FROM p a, p b)"""
RADII = "r AS (SELECT id, side, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d WHERE side = side2 AND id <> id2) WHERE k = {k})"


@query("pairwise_dist", f"WITH {PAIRS} SELECT id, id2, round(d, 6) AS d FROM d WHERE side = 0 AND side2 = 1")
def pairwise_dist(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each pair of a real and a synthetic vector, by definition."""
    return twosample.pairwise(_blocks(spark, sf, 0), _blocks(spark, sf, 1)).withColumn("d", F.round("d", 6))


@query("kernel_matrix", f"WITH {PAIRS} SELECT id, id2, round(1 / (1 + d), 9) AS k FROM d WHERE side = 0 AND side2 = 0")
def kernel_matrix(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf, 0)
    return twosample.kernel_matrix(b, b, lambda d: 1 / (1 + d)).withColumn("k", F.round("k", 9))


@query("k_smallest", f"WITH {PAIRS} SELECT id, k::INTEGER AS k, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d WHERE side = 0 AND side2 = 0 AND id <> id2) WHERE k <= 3")
def k_smallest(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf, 0)
    near = twosample.k_smallest(b, b, 3, True).select("id", F.posexplode("d").alias("k", "d"))
    return near.select("id", (F.col("k") + 1).alias("k"), F.round("d", 6).alias("d"))


@query(
    "knn_precision_recall",
    f"""WITH {PAIRS}, {RADII.format(k=3)}, hit AS (SELECT d.id2 AS id, d.side2 AS side, bool_or(d.d <= r.r) AS inside FROM d JOIN r ON d.id = r.id WHERE d.side <> d.side2 GROUP BY ALL)
    SELECT round(avg(inside::INTEGER) FILTER (WHERE side = 1), 6) AS precision, round(avg(inside::INTEGER) FILTER (WHERE side = 0), 6) AS recall FROM hit""",
)
def knn_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    out = twosample.precision_recall(_blocks(spark, sf, 0), _blocks(spark, sf, 1), 3)
    return out.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "prdc",
    f"""WITH {PAIRS}, {RADII.format(k=5)}, hit AS (SELECT d.id2 AS id, d.side2 AS side, count(*) FILTER (WHERE d.d < r.r) AS inside FROM d JOIN r ON d.id = r.id WHERE d.side <> d.side2 GROUP BY ALL),
    near AS (SELECT d.id, min(d.d) AS m FROM d WHERE side = 0 AND side2 = 1 GROUP BY d.id)
    SELECT round(avg((inside > 0)::INTEGER) FILTER (WHERE side = 1), 6) AS precision, round(avg((inside > 0)::INTEGER) FILTER (WHERE side = 0), 6) AS recall, round(avg(inside / 5.0::DOUBLE) FILTER (WHERE side = 1), 6) AS density,
      (SELECT round(avg((m < r)::INTEGER), 6) FROM near JOIN r USING (id)) AS coverage FROM hit""",
)
def prdc(spark: SparkSession, sf: str) -> DataFrame:
    return twosample.prdc(_blocks(spark, sf, 0), _blocks(spark, sf, 1), 5)


def _mmd_sql(gamma: str) -> str:
    return f"""WITH {PAIRS}, k AS (SELECT side, side2, id = id2 AS own, exp(-{gamma} * d * d) AS k FROM d),
    s AS (SELECT avg(k) FILTER (WHERE side = 0 AND side2 = 0) AS x, avg(k) FILTER (WHERE side = 1 AND side2 = 1) AS y, avg(k) FILTER (WHERE side <> side2) AS c,
      avg(k) FILTER (WHERE side = 0 AND side2 = 0 AND NOT own) AS ux, avg(k) FILTER (WHERE side = 1 AND side2 = 1 AND NOT own) AS uy FROM k)"""


@query("mmd_rbf", f"{_mmd_sql('0.5::DOUBLE')} SELECT round(x + y - 2 * c, 8) AS mmd FROM s")
def mmd_rbf(spark: SparkSession, sf: str) -> DataFrame:
    return twosample.mmd(_blocks(spark, sf, 0), _blocks(spark, sf, 1), 0.5).select(F.round("biased", 8).alias("mmd"))


@query("mmd_biased", f"{_mmd_sql('1.0::DOUBLE')} SELECT round(x + y - 2 * c, 8) AS mmd FROM s")
def mmd_biased(spark: SparkSession, sf: str) -> DataFrame:
    return twosample.mmd(_blocks(spark, sf, 0), _blocks(spark, sf, 1)).select(F.round("biased", 8).alias("mmd"))


@query(
    "mmd_unbiased",
    f"""{_mmd_sql('1.0::DOUBLE')}, o AS (SELECT id, v, side, row_number() OVER (PARTITION BY side ORDER BY id) AS r FROM p), z AS (SELECT count(*) FILTER (WHERE side = 0) AS m, count(*) FILTER (WHERE side = 1) AS n FROM p),
    same AS (SELECT sum(exp(-1 * pow(list_distance(a.v, b.v), 2))) AS t FROM o a JOIN o b ON a.side = 0 AND b.side = 1 AND a.r = b.r)
    SELECT round(CASE WHEN m = n THEN ux + uy - 2 * (c * m * n - t) / (m * (m - 1)) ELSE ux + uy - 2 * c END, 8) AS mmd FROM s, z, same""",
)
def mmd_unbiased(spark: SparkSession, sf: str) -> DataFrame:
    paired = twosample.paired_distances(*_sides(spark, sf), "vec_id", "embedding")
    return twosample.mmd(_blocks(spark, sf, 0), _blocks(spark, sf, 1), paired=paired).select(F.round("unbiased", 8).alias("mmd"))


def _traits(spark: SparkSession, sf: str, parity: int) -> DataFrame:
    v = F.array(*[x.cast("double") for x in (F.col("c_nationkey"), F.col("c_acctbal") / 500, F.length("c_mktsegment"))])
    return _half(spark, sf, "customer", "c_custkey", parity).select("c_custkey", v.alias("v"))


@query(
    "identifiability",
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 2 AS side, [c_nationkey, c_acctbal / 500, length(c_mktsegment)]::DOUBLE[] AS v FROM customer),
    long AS (SELECT unnest(range(0, 3)) AS i, unnest(v) AS x FROM p WHERE side = 0), c AS (SELECT i, x, count(*) AS n FROM long GROUP BY ALL),
    w AS (SELECT list(w ORDER BY i) AS w FROM (SELECT i, 1 / greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 2.220446049250313e-16) AS w FROM c GROUP BY i)),
    q AS (SELECT id, side, [v[1] * w[1], v[2] * w[2], v[3] * w[3]] AS v FROM p, w),
    d AS (SELECT a.id, min(list_distance(a.v, b.v)) FILTER (WHERE b.side = 0 AND a.id <> b.id) AS other, min(list_distance(a.v, b.v)) FILTER (WHERE b.side = 1) AS synth FROM q a, q b WHERE a.side = 0 GROUP BY a.id)
    SELECT round(avg((synth < other)::INTEGER), 6) AS score FROM d""",
)
def identifiability(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = _traits(spark, sf, 0), _traits(spark, sf, 1)
    weights = {r["i"]: r["w"] for r in twosample.entropy_weights(real, "v").collect()}  # a number for each component
    a, b = (twosample.weighted(d, "v", weights) for d in (real, synth))
    return twosample.identifiability(a, b, "v").select(F.round("score", 6).alias("score"))


@query("kde_logdensity", f"WITH {PAIRS} SELECT id, round(ln(avg(exp(-d * d / (2 * 0.25::DOUBLE)))) - 64 * (ln(0.5::DOUBLE) + 0.5::DOUBLE * ln(2 * pi())), 6) AS log_density FROM d WHERE side = 0 AND side2 = 1 GROUP BY id")
def kde_logdensity(spark: SparkSession, sf: str) -> DataFrame:
    return twosample.kde_log_density(_blocks(spark, sf, 0), _blocks(spark, sf, 1), 0.5, 64).withColumn("log_density", F.round("log_density", 6))


@query("auc_rank", "SELECT round(sum(CASE WHEN a.value > b.value THEN 1.0::DOUBLE WHEN a.value = b.value THEN 0.5::DOUBLE ELSE 0 END) / count(*), 9) AS auc FROM (SELECT round(value, 0) AS value FROM events WHERE event_type = 'purchase') a, (SELECT round(value, 0) AS value FROM events WHERE event_type <> 'purchase') b")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select(F.round("value", 0).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return twosample.auc(scores, "score", "label").select(F.round("auc", 9).alias("auc"))


@query("membership_inference")
def membership_inference(spark: SparkSession, sf: str) -> DataFrame:
    parts = [twosample.blocks(table(spark, sf, "embeddings").where(F.col("vec_id") % 4 == k), "vec_id", "embedding") for k in range(4)]
    scores = twosample.membership_inference(*parts, 64)
    return twosample.attack_quality(scores)


@query("membership_prior")
def membership_prior(spark: SparkSession, sf: str) -> DataFrame:
    """The attack with a normal distribution fitted to the real rows as reference."""
    synth, members, others = (table(spark, sf, "embeddings").where(F.col("vec_id") % 3 == k) for k in range(3))
    parts = []
    for label, rows in ((1, members), (0, others)):
        g = twosample.kde_log_density(twosample.blocks(rows, "vec_id", "embedding"), twosample.blocks(synth, "vec_id", "embedding"), 0.5, 64).withColumnRenamed("log_density", "g")
        r = twosample.normal_log_density(rows, members.union(others), "vec_id", "embedding").withColumnRenamed("log_density", "r")
        parts.append(g.join(r, "id").select("id", F.lit(label).alias("member"), (F.col("g") - F.col("r")).alias("score")))
    return twosample.attack_quality(parts[0].unionByName(parts[1]))


COUNTS = "(SELECT o_orderpriority AS v, count(*) FILTER (WHERE o_orderkey % 2 = 0) / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)::DOUBLE AS p, count(*) FILTER (WHERE o_orderkey % 2 = 1) / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1)::DOUBLE AS q FROM orders GROUP BY 1)"


@query("kl_div", f"SELECT round(sum(p * ln(p / q)), 8) AS kl FROM {COUNTS}")
def kl_div(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kl_divergence(_orders(spark, sf, 0), _orders(spark, sf, 1), "o_orderpriority").select(F.round("kl", 8).alias("kl"))


@query("jsd", f"SELECT round(sqrt((sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / 2), 8) AS js_distance FROM {COUNTS}")
def jsd(spark: SparkSession, sf: str) -> DataFrame:
    return stats.js_distance(_orders(spark, sf, 0), _orders(spark, sf, 1), "o_orderpriority").select(F.round("js_distance", 8).alias("js_distance"))


@query(
    "wasserstein_1d",
    """WITH c AS (SELECT o_totalprice AS v, sum((o_orderkey % 2 = 0)::INTEGER) AS r, sum((o_orderkey % 2 = 1)::INTEGER) AS s FROM orders GROUP BY 1),
    f AS (SELECT v, sum(r) OVER (ORDER BY v) / (SELECT sum(r) FROM c)::DOUBLE AS fr, sum(s) OVER (ORDER BY v) / (SELECT sum(s) FROM c)::DOUBLE AS fs, lead(v) OVER (ORDER BY v) - v AS w FROM c)
    SELECT round(sum(abs(fr - fs) * w), 4) AS wasserstein FROM f""",
)
def wasserstein_1d(spark: SparkSession, sf: str) -> DataFrame:
    return stats.wasserstein_1d(_orders(spark, sf, 0), _orders(spark, sf, 1), "o_totalprice").select(F.round("wasserstein", 4).alias("wasserstein"))


@query("col_kind", "SELECT 'l_linenumber' AS column_name, count(DISTINCT l_linenumber) >= 10 AS is_continuous FROM lineitem UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) >= 10 FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) >= 10 FROM lineitem")
def col_kind(spark: SparkSession, sf: str) -> DataFrame:
    return stats.column_kinds(table(spark, sf, "lineitem"), ["l_linenumber", "l_extendedprice", "l_returnflag"])


KERNELS = ["gaussian", "imq", "laplace", "matern_0.5", "matern_1.5", "matern_2.5", "matern_3.5", "matern_4.5"]
KERNEL_SQL = {
    "gaussian": "exp(-d*d)", "imq": "1/sqrt(1+d*d)", "laplace": "exp(-d)", "matern_0.5": "exp(-d)", "matern_1.5": "(1+sqrt(3)*d)*exp(-sqrt(3)*d)", "matern_2.5": "(1+sqrt(5)*d+5*d*d/3)*exp(-sqrt(5)*d)",
    "matern_3.5": "(1+sqrt(7)*d+14*d*d/5+7*sqrt(7)*d*d*d/15)*exp(-sqrt(7)*d)", "matern_4.5": "(1+3*d+27*d*d/7+18*d*d*d/7+27*d*d*d*d/35)*exp(-3*d)",
}


@query("kernel_values", " UNION ALL ".join(f"SELECT '{k}' AS kernel, i, round({KERNEL_SQL[k]}, 9) AS value FROM (SELECT i, (i / 4.0::DOUBLE) AS d FROM range(0, 21) r(i))" for k in KERNELS))
def kernel_values(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.range(21).select(F.col("id").alias("i"), (F.col("id") / 4.0).alias("d"))
    return stats.union_all([d.select(F.lit(k).alias("kernel"), "i", F.round(kernel(k, "d"), 9).alias("value")) for k in KERNELS])


@query(
    "bandwidth_grid",
    f"""WITH {PAIRS}, e AS (SELECT d FROM d WHERE id < id2), lo AS (SELECT CASE WHEN min(d) < 0.1 THEN greatest((SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM e) WHERE k = floor(n * 0.05::DOUBLE)), 0.1) ELSE min(d) END / 2 AS lo, greatest(max(d), 0.3) * 2 AS hi FROM e)
    SELECT i, round(lo * pow(hi / lo, i / 9.0::DOUBLE), 6) AS bandwidth FROM lo, range(0, 10) r(i)""",
)
def bandwidth_grid(spark: SparkSession, sf: str) -> DataFrame:
    blocks, _ = tests.pooled([table(spark, sf, "embeddings")], "vec_id", "embedding")
    grid = tests.bandwidth_grid(tests.Distances(blocks))
    return spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(grid)], "i bigint, bandwidth double")


@query(
    "mmdagg_weights",
    """WITH k AS (SELECT i, 1.0::DOUBLE AS uniform, 1.0::DOUBLE / i AS decreasing, 1.0::DOUBLE / (11 - i) AS increasing, 1.0::DOUBLE / (abs(5.5::DOUBLE - i) + 0.5::DOUBLE) AS centred FROM range(1, 11) r(i))
    SELECT i, round(uniform / sum(uniform) OVER (), 9) AS uniform, round(decreasing / sum(decreasing) OVER (), 9) AS decreasing, round(increasing / sum(increasing) OVER (), 9) AS increasing, round(centred / sum(centred) OVER (), 9) AS centred FROM k""",
)
def mmdagg_weights(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["uniform", "decreasing", "increasing", "centred"]
    columns = [tests.weights(10, k) for k in kinds]
    return spark.createDataFrame([(i + 1, *[round(float(c[i]), 9) for c in columns]) for i in range(10)], "i bigint, " + ", ".join(f"{k} double" for k in kinds))


@query("median_heuristic", f"WITH {PAIRS} SELECT round(sqrt(median(d * d) / 2), 6) AS sigma FROM d WHERE id < id2 AND d <> 0")
def median_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    blocks, _ = tests.pooled([table(spark, sf, "embeddings")], "vec_id", "embedding")
    return spark.createDataFrame([(round(tests.median_heuristic(blocks), 6),)], "sigma double")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _half(spark, sf, "embeddings", "vec_id", 0), _half(spark, sf, "embeddings", "vec_id", 1)


def _one_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query("mmd_perm")
def mmd_perm(spark: SparkSession, sf: str) -> DataFrame:
    return _one_row(spark, tests.permutation_test(*_sides(spark, sf), "vec_id", "embedding"))


@query("mmd_spectral")
def mmd_spectral(spark: SparkSession, sf: str) -> DataFrame:
    return _one_row(spark, tests.spectral_test(*_sides(spark, sf), "vec_id", "embedding"))


@query("mmdagg")
def mmdagg(spark: SparkSession, sf: str) -> DataFrame:
    return tests.mmdagg(*_sides(spark, sf), "vec_id", "embedding")


@query("mmd_3sample")
def mmd_3sample(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, "embeddings").where(F.col("vec_id") % 3 == k) for k in range(3)]
    return _one_row(spark, tests.relative_test(*parts, "vec_id", "embedding"))
