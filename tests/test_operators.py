"""Golden examples and properties of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialspark import schema
from trialspark.operators import audit, merge, mmd, models, prep, privacy, ranging, resampled, sequences, stats, subjects, twosample
from trialspark.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_merge_to_string(spark):
    df = spark.createDataFrame([("A", 1, "X"), ("B", 2, "Y"), ("C", 3, None)], "col1 string, col2 int, col3 string")
    assert rows(prep.merge_to_string(df, ["col1", "col2", "col3"], "m")) == [("A_1_X",), ("B_2_Y",), ("C_3_nan",)]


def test_copy_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c"), (4.0, "d")], "a double, b string")
    assert {r["b"] for r in prep.copy_nulls(df, "a", "b").collect()} == {"a", "b", None, "d"}


def test_drop_singletons(spark):
    df = spark.createDataFrame([("foo",), ("foo",), ("bar",), (None,), (None,)], "a string")
    assert rows(subjects.drop_singletons(df, "a")) == [("foo",), ("foo",)]


def test_column_classes(spark):
    df = spark.createDataFrame([(1, "a", True, [1])], "n int, s string, b boolean, v array<int>")
    assert schema.classify_columns(df) == {"numeric": ["n"], "boolean": ["b"], "categorical": ["s"], "datetime": []}
    assert schema.column_order(df) == ["s", "n", "b", "v"]
    assert schema.strip_prefixes(df.toDF("num__n", "cat__s", "bool__b", "v")).columns == ["n", "s", "b", "v"]
    assert schema.as_list("x") == ["x"] and schema.as_list(None) == [] and schema.chunked([1, 2, 3], 2) == [[1, 2], [3]]
    assert schema.powers_of_two(2, 16) == [2, 4, 8, 16]


def test_schema_checks_roles():
    with pytest.raises(TypeError):
        schema.TrialSchema(["uid"], use_secondary_id="Flase")
    with pytest.raises(ValueError, match="both"):
        schema.TrialSchema(["uid"], ["a"], ["a"])
    assert schema.TrialSchema(["uid"], ["sex"], ["size"], "date", ["day"]).metadata()["date"] == "sequence_index"


def test_null_only_strings_become_boolean(spark):
    df = spark.createDataFrame([(None, "x"), (" ", "Yes")], "a string, b string")
    assert dict(prep.BooleanMapper.fit(df).transform(df).dtypes) == {"a": "boolean", "b": "string"}


def test_encoder_unknown_and_constant(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "c string, x double")
    new = spark.createDataFrame([("z", 3.0)], "c string, x double")
    assert rows(prep.Encoder.fit(train).transform(new)) == [(0.0, 0.0, 2.0)]


def test_kmeans_edges():
    values, weights = np.array([0.0, 1.0, 10.0, 11.0]), np.ones(4)
    assert prep.lloyd_1d(lambda c: prep.lloyd_step(values, weights, c), 0.0, 11.0, 2) == [0.5, 10.5]


def test_binner_is_closed_on_the_left(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (10.0,), (99.0,), (None,)], "x double")
    assert [r[0] for r in prep.Binner({"x": [0.0, 5.0, 10.0]}, {"x": [2.5, 7.5]}).transform(df).collect()] == [0, 0, 1, 1, 1, None]


def test_field_mask_golden(spark):
    df = spark.createDataFrame([(["[BOS]", "Female", "White", "[START_EVENT]", "A", "38", "[START_EVENT]", "A", "37", "[PAD]"],)], "t array<string>")
    got = df.select(sequences.field_mask(F.col("t"), ["Sex", "Gender"], ["Type", "Size"])).first()[0]
    assert got == ["SPECIAL", "Sex", "Gender", "SPECIAL", "Type", "Size", "SPECIAL", "Type", "Size", "SPECIAL"]


def test_padding_golden(spark):
    df = spark.createDataFrame([(["1", "2", "3"],)], "t array<string>")
    out = sequences.pad(df, "t", 5).first()
    assert out["t"] == ["1", "2", "3", "[PAD]", "[PAD]"] and out["attention_mask"] == [1, 1, 1, 0, 0]


def test_sequences_to_table_golden(spark):
    df = spark.createDataFrame([(1, ["[BOS]", "p", "c", "[START_EVENT]", "a", "b", "[START_EVENT]", "x", "y"])], "id int, s array<string>")
    assert rows(sequences.sequences_to_table(df, "id", "s", ["P", "C"], ["A", "B"])) == [(1, 1, "p", "c", "a", "b"), (1, 2, "p", "c", "x", "y")]


def test_recent_sequence_repeats_the_first_event(spark):
    df = spark.createDataFrame([(1, k, str(k)) for k in range(4)], "id int, t int, e string")
    out = sequences.recent_sequences(df, ["id"], ["t"], [], ["e"], 3, 1, sep=None).first()
    assert out["sequence"] == ["0", "0", "1", "2", "3"] and out["n_events"] == 3
    assert sequences.recent_sequences(df, ["id"], ["t"], [], ["e"], 3, 4).count() == 0


def test_unknown_token_is_an_error(spark):
    vocab = sequences.vocabulary(spark.createDataFrame([("a",)], "f string"), ["f"])
    df = spark.createDataFrame([(1, ["zz"], ["f"])], "id int, t array<string>, n array<string>")
    with pytest.raises(PySparkException, match="not in the vocabulary"):
        sequences.encode(df, ["id"], "t", "n", vocab).collect()


def test_disjoint_quasi_identifiers_have_no_risk(spark):
    real = spark.createDataFrame([(k, "F", k * 10) for k in range(5)], "age int, gender string, income int")
    synth = spark.createDataFrame([(k + 50, "M", k * 10) for k in range(5)], "age int, gender string, income int")
    classes = privacy.equivalence_classes(real, synth, ["age", "gender"]).withColumn("Rs_income", F.lit(1))
    assert rows(privacy.disclosure_risk(classes, 5, 5, ["income"])) == [("income", 0.0)]


def test_natural_breaks_against_all_cuts():
    rng = np.random.default_rng(0)
    x, w = np.sort(rng.integers(0, 60, 9)).astype(float), rng.integers(1, 5, 9).astype(float)
    from itertools import combinations

    def within(cuts):
        parts = np.split(np.arange(9), cuts)
        return sum((w[p] * (x[p] - np.average(x[p], weights=w[p])) ** 2).sum() for p in parts)

    for k, (cost, _) in enumerate(privacy.natural_breaks(x, w, 4), 1):
        assert cost == pytest.approx(min(within(list(c)) for c in combinations(range(1, 9), k - 1)), abs=1e-9)


def test_natural_breaks_of_many_values():
    x = np.sort(np.random.default_rng(1).gamma(2.0, size=5000))
    fits = privacy.natural_breaks(x, np.ones(5000), 4)
    cuts = np.searchsorted(x, fits[2][1], side="right")
    cost = lambda c: sum(((p - p.mean()) ** 2).sum() for p in np.split(x, c))
    assert fits[2][0] == pytest.approx(cost(cuts))
    for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        assert cost(cuts + [i, j]) >= cost(cuts)


def test_split_keeps_subjects_together(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    train, test = subjects.grouped_split(orders, ["o_custkey"], 0.25)
    assert train.count() + test.count() == orders.count()
    assert not train.join(test, "o_custkey", "left_semi").count()


def test_ordinals_are_dense(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = rows(ranging.with_ordinal(df, ["k"]).select("k", "_row"))
    assert out == [(k, k) for k in range(1000)]


@pytest.mark.parametrize("partitions", [8, 200])
def test_ranges_hold_at_size(spark, partitions):
    """Wide rows, pruned columns, several evaluations: what goes wrong where ranges are computed twice."""
    n, before = 400_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("a"), F.repeat(F.md5((F.col("id") + 1).cast("string")), 4).alias("b"))
        numbered = ranging.with_ordinal(df, ["k"])
        for _ in range(2):
            assert numbered.agg(F.count(F.lit(1)), F.sum((F.col("k") != F.col("_row")).cast("int"))).first()[:] == (n, 0)
        assert numbered.where("a is null or b is null").count() == 0
        values = spark.range(n).select(F.floor(F.sqrt(F.col("id").cast("double"))).alias("x"), F.col("id"))
        x = np.floor(np.sqrt(np.arange(n)))
        shares = dict(rows(stats.ecdf(values, "x", values, "x")))
        assert all(shares[v] == pytest.approx((x <= v).mean()) for v in (0.0, 1.0, 300.0, 632.0))
        scores = values.select(F.col("x").alias("s"), (F.xxhash64("id") % 2 == 0).cast("int").alias("l"))
        label = np.array([r[0] for r in scores.select("l").collect()])
        p, q = (np.bincount(x[label == c].astype(int), minlength=700) for c in (1, 0))
        won = (p * (np.cumsum(q) - q + q / 2)).sum() / (p.sum() * q.sum())
        assert twosample.auc(scores, "s", "l").first()[0] == pytest.approx(won)
        shifted = values.select((F.col("x") + 3).alias("x"))
        assert stats.wasserstein_1d(values, shifted, "x").first()[0] == pytest.approx(3)
        assert ranging.exact_quantiles(values, "x", [0.0, 0.31, 0.5, 1.0]) == pytest.approx(list(np.quantile(x, [0.0, 0.31, 0.5, 1.0])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_binner_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    for strategy in ("uniform", "quantile", "kmeans"):
        b = prep.Binner.fit(df, ["x"], 4, strategy)
        assert b.transform(df).first()[0] is None and b.inverse(b.transform(df)).first()[0] is None


def test_kmeans_is_the_same_on_the_cluster(spark, monkeypatch):
    df = spark.range(3000).select(F.sqrt(F.col("id").cast("double")).alias("x"))
    here = prep.Binner.fit(df, ["x"], 5, "kmeans")
    monkeypatch.setattr(prep.Binner, "KMEANS_VALUES", 10)
    assert prep.Binner.fit(df, ["x"], 5, "kmeans").centres["x"] == pytest.approx(here.centres["x"], abs=1e-9)


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3)], "k string, v int")
    assert merge.pair_merge(a, b, ["k"]).where("k is null").first()["v_right"] == 3


def test_same_table_has_no_distance(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60")
    b = twosample.blocks(e, "vec_id", "embedding", 16)
    assert tuple(twosample.precision_recall(b, b).first()) == (1.0, 1.0)
    assert twosample.mmd(b, b).first()["biased"] == pytest.approx(0, abs=1e-9)
    assert stats.frechet_distance(e, e, "embedding") == pytest.approx(0, abs=1e-5)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for f, c in ((stats.kl_divergence, "o_orderstatus"), (stats.js_distance, "o_orderstatus"), (stats.wasserstein_1d, "o_totalprice")):
        assert f(orders, orders, c).first()[0] == pytest.approx(0, abs=1e-9)


def test_resampling_tests_see_a_shift(spark):
    rng = np.random.default_rng(1)
    make = lambda shift: spark.createDataFrame([(i, (rng.normal(size=3) + shift).tolist()) for i in range(60)], "k int, v array<double>")
    a, b, c = make(0.0), make(0.0), make(2.0)
    assert mmd.permutation_test(a, c, "k", "v", resamples=100)["reject"] == 1.0
    assert mmd.permutation_test(a, c, "k", "v", resamples=100)["statistic"] > mmd.permutation_test(a, b, "k", "v", resamples=100)["statistic"]
    assert not mmd.mmdagg(a, b, "k", "v", number=3, b1=100, b2=100, b3=20).first()["reject"]
    assert mmd.spectral_test(a, c, "k", "v")["reject"] == 1.0
    assert mmd.mmdagg(a, c, "k", "v", number=3, b1=100, b2=100, b3=20).first()["reject"]
    assert mmd.relative_test(a, c, b, "k", "v")["p_value"] < 0.05
    with pytest.raises(ValueError, match="equal size"):
        mmd.spectral_test(a, c.where("k < 10"), "k", "v")


def test_kernel_forms_against_whole_matrices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(23, 3)), rng.normal(size=(23, 3)) + 0.5
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "k int, v array<double>") for z in (x, y))
    blocks, sizes = mmd.pooled([a, b], "k", "v", 10)
    assert sizes == [23, 23] and blocks.count() == 5
    ids = np.concatenate([2 * np.arange(23), 2 * np.arange(23) + 1])
    z = np.concatenate([x, y])
    k = np.exp(-((z[:, None] - z[None, :]) ** 2).sum(2) / 1.5**2)
    k[ids[:, None] // 2 == ids[None, :] // 2] = 0
    s = mmd.wild(3, 4)(ids)
    q, line, every = mmd.forms(blocks, "gaussian", np.array([1.5]), mmd.wild(3, 4), "paired")
    assert q[0] == pytest.approx((s * (k @ s)).sum(0)) and line[0] == pytest.approx(s.T @ k.sum(1)) and every[0] == pytest.approx([k.sum()] * 5)
    design = mmd.permuted(blocks, 23, 1, 50)
    whole = np.concatenate([design(np.array(r["ids"])) for r in blocks.collect()])
    assert (whole.sum(0) == 23).all() and len({tuple(c) for c in whole.T}) > 45
    d = np.sqrt(((x[:, None] - y[None, :]) ** 2).sum(2)).ravel()
    monkeypatch.setattr(mmd, "FINE", 5)
    between = mmd.Distances(blocks, lambda a, b: (a % 2 == 0) & (b % 2 == 1))
    n, zeros, low, high = between.ends()
    assert (n, zeros, low, high) == (529, 0, pytest.approx(d.min()), pytest.approx(d.max()))
    assert [between.at(r, low, high) for r in (0, 26, 264, 528)] == pytest.approx(np.sort(d)[[0, 26, 264, 528]].tolist())
    # the null draws have the mean and variance of the spectrum's weighted sum of squares
    got = mmd.spectral_test(a, b, "k", "v", scale=1.0, draws=4000)
    g = np.exp(-((z[:, None] - z[None, :]) ** 2).sum(2) / 2)
    centre = np.eye(46) - 1 / 46
    eigen = np.linalg.eigvalsh(centre @ g @ centre) / 46
    null = 2 * (eigen[:, None] * rng.standard_normal((46, 20_000)) ** 2).sum(0)
    assert got["threshold"] == pytest.approx(np.quantile(null, 0.95), rel=0.1)
    sign = np.where(ids % 2 == 0, 1, -1)
    assert got["statistic"] == pytest.approx(sign @ g @ sign / 23)
    assert mmd.permutation_test(a, b, "k", "v", scale=1.0, resamples=50)["statistic"] == pytest.approx(sign @ g @ sign / 23**2)
    unequal = mmd.mmdagg(a, b.where("k < 20"), "k", "v", kernel="gaussian", number=2, b1=40, b2=40, b3=5).first()
    kk = np.exp(-((z[:, None] - z[None, :]) ** 2).sum(2) / unequal["bandwidth"] ** 2)
    i, j = np.arange(23), 23 + np.arange(20)
    off = lambda m: m.sum() - np.trace(m)
    assert unequal["statistic"] == pytest.approx(off(kk[np.ix_(i, i)]) / (23 * 22) + off(kk[np.ix_(j, j)]) / (20 * 19) - 2 * kk[np.ix_(i, j)].mean())
    metrics = dict(rows(mmd.mmdagg_evaluation(a, a, b, "k", "v", number=2, b1=40, b2=40, b3=5)))
    assert metrics["mmdagg_p_value_train"] == metrics["mmdagg_p_value_validation"]
    with pytest.raises(ValueError, match="unknown scheme"):
        mmd.boot_test(a, b, "k", "v", "other")


def test_wild_bootstrap_takes_only_open_ranks_in_double_precision(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(150, 6)), rng.normal(size=(150, 6)) * 1.1
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "k int, v array<double>") for z in (x, y))
    options = dict(number=5, b1=300, b2=300, b3=30, level=0.2)
    plain, taken = mmd.forms, []
    exact = resampled.exact_values
    monkeypatch.setattr(mmd, "forms", lambda *args, **kwargs: pytest.fail("all values in double precision"))
    monkeypatch.setattr(resampled, "exact_values", lambda *args: taken.append(args[4]) or exact(*args))
    got = mmd.mmdagg(a, b, "k", "v", **options).collect()
    assert taken and sum(w.sum() for w in taken) < 0.2 * 10 * 601
    ids, z = np.concatenate([2 * np.arange(150), 2 * np.arange(150) + 1]), np.concatenate([x, y])
    s, out = mmd.wild(42, 600)(ids), []
    for r in got:
        d = np.abs(z[:, None] - z[None, :]).sum(2) if r["kernel"] == "laplace" else np.sqrt(((z[:, None] - z[None, :]) ** 2).sum(2))
        k = mmd.kernel_of(r["kernel"], d / r["bandwidth"])
        k[ids[:, None] // 2 == ids[None, :] // 2] = 0
        out.append((s * (k @ s)).sum(0) / (150 * 149))
    out = np.array(out)
    first, second = np.sort(out[:, :301], axis=1), out[:, 301:]
    low, high = 0.0, 10.0
    for _ in range(30):
        u = (low + high) / 2
        place = lambda u: min(max(int(np.ceil((1 - u / 10) * 301)) - 1, 0), 300)
        low, high = (u, high) if (second > first[:, place(u), None]).any(0).mean() <= 0.2 else (low, u)
    assert [r["statistic"] for r in got] == pytest.approx(out[:, 0].tolist(), rel=1e-9)
    assert [r["p_value"] for r in got] == (first >= out[:, :1]).mean(1).tolist()
    assert [r["threshold"] for r in got] == pytest.approx(first[:, place(low)].tolist(), rel=1e-9)
    # bounds that exact values do not bear out count for nothing
    monkeypatch.setattr(mmd, "forms", plain)
    monkeypatch.setattr(resampled, "_TRUST", 0.0)
    for r, other in zip(got, mmd.mmdagg(a, b, "k", "v", **options).collect(), strict=True):
        assert (r["kernel"], r["p_value"], r["reject"]) == (other["kernel"], other["p_value"], other["reject"])
        assert (r["statistic"], r["threshold"]) == (pytest.approx(other["statistic"], rel=1e-9), pytest.approx(other["threshold"], rel=1e-9))


def test_bounds_name_the_statistics_that_a_rank_needs():
    rng = np.random.default_rng(2)
    out, w = rng.normal(size=(3, 81)), np.full(3, 1 / 3)
    (p, cut), need = resampled.settled(out, out, w, 40, 20, 0.3)
    assert not need.any()
    low, high = out - rng.random((3, 81)) * 0.1, out + rng.random((3, 81)) * 0.1
    for _ in range(20):
        found, need = resampled.settled(low, high, w, 40, 20, 0.3)
        if found:
            break
        assert need.any() and (low < high)[need].all()
        low[need] = high[need] = out[need]
    assert found[0].tolist() == p.tolist() and found[1].tolist() == cut.tolist() and (low < high).mean() > 0.3


def _sample(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")


def _all_distances(a, b):
    return np.sqrt(((a[:, None] - b[None, :]) ** 2).sum(2))


def test_distances_by_matrix_product_are_exact_where_it_cancels():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(70, 9)) + 1e6
    b = np.concatenate([a[:30], a[30:50] + 1e-7, rng.normal(size=(20, 9))])
    plain = _all_distances(a, b)
    assert twosample.distances(a, b) == pytest.approx(plain, rel=1e-11, abs=0)
    assert (twosample.distances(a, b)[np.arange(30), np.arange(30)] == 0).all()
    assert twosample.distances(a, b, "l1") == pytest.approx(np.abs(a[:, None] - b[None, :]).sum(2), rel=1e-11, abs=0)
    a[3, 1] = np.inf
    got = twosample.distances(a, b)
    assert np.isinf(got[3]).all() and np.isfinite(np.delete(got, 3, 0)[:, 4:]).all()
    assert twosample.unpack(twosample.pack(b), 70).tolist() == b.tolist() and len(twosample.pack(np.float32(b).astype(float))) == 70 * 9 * 4 + 1


def test_no_matrix_of_differences(monkeypatch):
    # a query's distances come from a product of matrices: few pairs are measured one by one
    counted = []
    whole = twosample.exact_pairs
    monkeypatch.setattr(twosample, "exact_pairs", lambda a, b, i, j: counted.append(len(i)) or whole(a, b, i, j))
    x = np.random.default_rng(3).normal(size=(400, 16))
    assert twosample.squares(x, x) == pytest.approx(_all_distances(x, x) ** 2, rel=1e-10, abs=0) and sum(counted) < 1000


def test_order_statistics_share_their_passes(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(41, 3))
    x[7] = x[9]
    blocks, _ = mmd.pooled([_sample(spark, x)], "k", "v", 16)
    passes, each = [], mmd.Distances._each
    monkeypatch.setattr(mmd.Distances, "_each", lambda self, *a: passes.append(1) or each(self, *a))
    d = np.sort(_all_distances(x, x)[np.triu_indices(41, 1)])
    assert mmd.median_heuristic(blocks) == pytest.approx(np.sqrt(np.median(d[d > 0] ** 2) / 2)) and len(passes) == 3
    passes.clear()
    grid = mmd.bandwidth_grid(mmd.Distances(blocks, lambda a, b: a < b))
    filled = np.where(d == 0, np.median(d), d)
    low = filled.min() if filled.min() >= 0.1 else max(np.sort(filled)[int(0.05 * len(d))], 0.1)
    assert (grid[0], grid[-1]) == (pytest.approx(low / 2), pytest.approx(d.max() * 2)) and len(passes) == 3


def test_order_statistics_in_single_precision_are_exact(spark, monkeypatch):
    # far from the origin, with copies, near copies and many ties; ranks beyond what the guess covers
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(50, 4)), rng.integers(0, 2, (40, 4)), np.full((12, 4), 0.5)]) + 1000.0
    x[3] = x[4] + 1e-7
    blocks, _ = mmd.pooled([_sample(spark, x)], "k", "v", 16)
    d = np.sort(_all_distances(x, x)[np.triu_indices(len(x), 1)])
    some = d[d > 0]
    for fine, guesses in ((1_000_000, 1 << 20), (5, 40)):
        monkeypatch.setattr(mmd, "FINE", fine)
        monkeypatch.setattr(mmd, "GUESSES", guesses)
        each = mmd.Distances(blocks)
        n, zeros, low, high = each.ends()
        assert (n, zeros, low, high) == (len(d), len(d) - len(some), pytest.approx(some[0]), pytest.approx(some[-1]))
        ranks = [0, 1, len(some) // 20, len(some) // 2, len(some) - 1]
        assert each.ranked(ranks, low, high) == pytest.approx(some[ranks].tolist(), rel=1e-9)
    assert mmd.median_heuristic(blocks) == pytest.approx(np.sqrt(np.median(some**2) / 2), rel=1e-9)


def test_spectral_multiplies_what_is_not_zero(spark):
    # a kernel so narrow that only near copies have a value: the draws are those of the whole matrix
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2, 60, 6)) * 10
    x[1, :5] = x[0, 20:25] + 0.01
    blocks, _ = mmd.pooled([_sample(spark, x[0]), _sample(spark, x[1])], "k", "v", 24)
    whole = mmd.forms(blocks, "gaussian", np.array([0.5]), mmd.gaussian(3, 40))
    few = mmd.forms(blocks, "gaussian", np.array([0.5]), mmd.gaussian(3, 40), least=1e-16 / 120)
    for a, b in zip(whole, few, strict=True):
        assert b == pytest.approx(a, rel=1e-12)


def test_three_samples_meet_every_two_blocks_once(spark, monkeypatch):
    calls, whole = spark.sparkContext.accumulator(0), mmd.squares
    monkeypatch.setattr(mmd, "squares", lambda a, b: calls.add(len(a) * len(b)) or whole(a, b))
    monkeypatch.setattr(mmd.pooled, "__defaults__", (12,))
    x = np.random.default_rng(12).normal(size=(3, 40, 3))
    x[2] += 0.5
    got = mmd.relative_test(*(_sample(spark, p) for p in x), "k", "v", 1.5)
    assert 0 < calls.value < 0.6 * 120**2
    k = [[np.exp(-(_all_distances(p, q) ** 2) / 4.5) for q in x] for p in x]
    for s in range(3):
        np.fill_diagonal(k[s][s], 0)
    h = (k[0][2].mean(1) - k[0][1].mean(1), k[1][1].sum(1) / 39 - k[1][0].mean(1), k[2][0].mean(1) - k[2][2].sum(1) / 39)
    t = k[1][1].sum() / (40 * 39) - 2 * k[0][1].mean() - k[2][2].sum() / (40 * 39) + 2 * k[0][2].mean()
    assert got["statistic"] == pytest.approx(t / np.sqrt(4 * sum(v.var() / 40 for v in h)))


def test_attack_scores_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.range(50).selectExpr("cast(id as double) as score", "cast(id % 2 as int) as member").mapInArrow(score, "score double, member int")
    assert tuple(twosample.attack_quality(scores).first()) == pytest.approx((0.52, 0.52))
    assert made.value == 50


def test_neighbours_and_balls_with_copies(spark):
    # radii and distances tie between copies that lie in different blocks
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))
    real, synth = np.concatenate([x[:40], x[:8], x[:8]]), np.concatenate([x[20:60], x[:5], x[20:24] + 1e-9])
    a, b = twosample.blocks(_sample(spark, real), "k", "v", 16), twosample.blocks(_sample(spark, synth, 1000), "k", "v", 16)
    own, other, cross = _all_distances(real, real), _all_distances(synth, synth), _all_distances(real, synth)
    radius = lambda d, k: np.sort(np.where(np.eye(len(d)) == 1, np.inf, d), 1)[:, k - 1]
    for k in (1, 3):
        r, s = radius(own, k), radius(other, k)
        got = twosample.prdc(a, b, k).first()
        inside = cross < r[:, None]
        assert tuple(got) == pytest.approx((inside.any(0).mean(), (cross < s[None, :]).any(1).mean(), inside.sum(0).mean() / k, (cross.min(1) < r).mean()), abs=1e-6)
        assert tuple(twosample.precision_recall(a, b, k).first()) == pytest.approx(((cross <= r[:, None]).any(0).mean(), (cross <= s[None, :]).any(1).mean()))
    near = {r["id"]: r["d"] for r in twosample.k_smallest(a, a, 3, True).collect()}
    assert [near[i] for i in range(len(real))] == [pytest.approx(v.tolist()) for v in np.sort(np.where(np.eye(len(real)) == 1, np.inf, own), 1)[:, :3]]


def test_neighbours_are_found_in_single_precision(spark, monkeypatch):
    """A double product is taken only where a single one is not finite; results are those of differences in either case."""
    rng = np.random.default_rng(6)
    real, synth = rng.normal(size=(300, 6)), rng.normal(size=(280, 6)) + 0.3
    real[:40], synth[:30] = real[40:80] + 1e-12, real[:30]
    real[290:], synth[270:] = 1e3 + rng.normal(size=(10, 6)) * 1e-4, 1e3 + rng.normal(size=(10, 6)) * 1e-4
    with monkeypatch.context() as m:  # in this process, one cell's work
        m.setattr(twosample, "_bounded", None)
        whole = twosample.Single(synth)
        for at, b, d, off in twosample._bounded_tiles(whole, real[:100]):
            assert d.dtype == np.float32 and np.array_equal(b, synth[at])
            assert (np.abs(d - _all_distances(real[:100], b) ** 2) <= off[:, None]).all()
    mask = rng.random((7, 24)) < 0.1
    assert all(np.array_equal(x, y) for m in (mask, mask[:, :5]) for x, y in zip(twosample._places(m), np.nonzero(m), strict=True))
    for scale in (1.0, 2.0**83):  # the second is beyond single precision's squares
        own, cross = _all_distances(real, real), _all_distances(real, synth)
        a, b = (twosample.blocks(_sample(spark, v * scale, f), "k", "v", 64) for v, f in ((real, 0), (synth, 1000)))
        near = {r["id"]: r["d"] for r in twosample.k_smallest(a, a, 3, True).collect()}
        assert np.allclose([near[i] for i in range(300)], scale * np.sort(np.where(np.eye(300) == 1, np.inf, own), 1)[:, :3], rtol=1e-9)
        radii = spark.createDataFrame([(i, near[i][-1]) for i in range(300)], "id bigint, r double")
        got = {r["id"]: (r["inside"], r["nearest"]) for r in twosample.within_radii(b, a, radii, True).collect()}
        r = np.array([near[i][-1] for i in range(300)]) / scale
        assert [got[1000 + j][0] for j in range(280)] == (cross <= r[:, None]).sum(0).tolist()
        assert np.allclose([got[1000 + j][1] for j in range(280)], scale * cross.min(0), rtol=1e-9)


def test_radii_are_measured_once(spark, monkeypatch):
    passes = spark.sparkContext.accumulator(0)
    a = twosample.blocks(_sample(spark, np.random.default_rng(7).normal(size=(60, 4))), "k", "v", 16)

    def counted(left, right, cell, schema, *more, f=twosample.block_cells):
        def each(*sides):
            passes.add(1)
            yield from cell(*sides)

        return f(left, right, each, schema, *more)

    monkeypatch.setattr(twosample, "block_cells", counted)
    twosample.block_pairs(a, a, lambda ids, x, ids2, y: [{"n": [len(ids)]}], "n bigint").collect()
    once, passes.value = passes.value, 0
    assert tuple(twosample.precision_recall(a, a).first()) == (1.0, 1.0)
    assert passes.value == 4 * once  # radii and balls of two sides


@pytest.mark.parametrize("dimensions", [3, 9])
def test_identifiability_searches_boxes(spark, monkeypatch, dimensions):
    rng = np.random.default_rng(dimensions)
    monkeypatch.setattr(twosample, "BOX", 12)
    real = rng.normal(size=(150, dimensions)).round(1)
    synth = np.concatenate([rng.normal(size=(60, dimensions)).round(1) + 2, real[:20], real[:20]])
    real = np.concatenate([real, real[10:30]])
    if dimensions == 3:  # no grid of all pairs
        monkeypatch.setattr(twosample, "block_cells", None)
    other = np.where(np.eye(len(real)) == 1, np.inf, _all_distances(real, real)).min(1)
    want = (_all_distances(real, synth).min(1) < other).mean()
    a, b = _sample(spark, real), _sample(spark, synth)
    assert twosample.identifiability(a, b, "v").first()["score"] == pytest.approx(want)
    far = twosample.identifiability(a, _sample(spark, synth[:3] + 50), "v")
    assert far.first()["score"] == 0
    assert twosample.identifiability(a.where("k < 1"), b, "v").first()["score"] is None
    assert twosample.identifiability(a, b.where("k < 0"), "v").first()["score"] is None


@pytest.mark.parametrize("drop", ["none", "own", "paired"])
def test_forms_meet_every_two_blocks_once(spark, monkeypatch, drop):
    calls, whole = spark.sparkContext.accumulator(0), mmd.distances

    def counted(a, b, norm):
        calls.add(len(a) * len(b))
        return whole(a, b, norm)

    monkeypatch.setattr(mmd, "distances", counted)
    monkeypatch.setattr(mmd, "_WIDE", 14)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2, 55, 3))
    blocks, _ = mmd.pooled([_sample(spark, x[0]), _sample(spark, x[1])], "k", "v", 10)
    ids, z = np.arange(110), x.transpose(1, 0, 2).reshape(110, 3)
    d = _all_distances(z, z)
    for design in (mmd.wild(3, 6), mmd.gaussian(3, 6)):
        before = calls.value
        q, line, every = mmd.forms(blocks, "gaussian", np.array([1.0, 2.0]), design, drop, "signs")
        assert calls.value - before < 0.6 * 110**2
        s, r = design(ids), np.where(ids % 2 == 0, 1, -1)
        for w, width in enumerate((1.0, 2.0)):
            k = np.exp(-((d / width) ** 2))
            if drop != "none":
                k[(ids[:, None] == ids[None, :]) if drop == "own" else (ids[:, None] // 2 == ids[None, :] // 2)] = 0
            assert q[w] == pytest.approx((s * (k @ s)).sum(0)) and line[w] == pytest.approx(s.T @ (k @ r)) and every[w] == pytest.approx([r @ k @ r] * s.shape[1])


def test_pairs_leave_a_cell_block_by_block(spark, monkeypatch):
    # a task hands on a pair of blocks at a time, and what is dealt out is in single precision where that is exact
    sizes, whole = spark.sparkContext.accumulator(0), twosample.unpack
    monkeypatch.setattr(twosample, "unpack", lambda data, rows: sizes.add(len(data)) or whole(data, rows))
    x = np.random.default_rng(9).normal(size=(64, 8)).astype("f4").astype(float)
    a = twosample.blocks(_sample(spark, x), "k", "v", 16)
    got = {(r["id"], r["id2"]): r["d"] for r in twosample.pairwise(a, a).collect()}
    d = _all_distances(x, x)
    assert len(got) == 64**2 and [got[i, j] for i in range(64) for j in range(64)] == pytest.approx(d.ravel().tolist())
    kernel = {(r["id"], r["id2"]): r["k"] for r in twosample.kernel_matrix(a, a, lambda v: 1 / (1 + v)).collect()}
    assert [kernel[i, j] for i in range(64) for j in range(64)] == pytest.approx((1 / (1 + d)).ravel().tolist())
    assert 0 < sizes.value < 2 * 2 * 4 * 64 * 8 * 5


def test_trust_index_grows_with_real_rows(spark, sf_dir):
    from trialspark.plans.audit_queries import registry

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    real = c.where("c_custkey % 2 = 0")
    synth = c.where("c_custkey % 2 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 5000)
    blends = subjects.blend_grid(real, synth, ["c_custkey"], [0.0, 0.5, 1.0])
    scores = registry().evaluate(real, {str(k): blends.where(F.col("dataset_id") == k) for k in range(3)}, ["wasserstein"])
    values = [r["value"] for r in scores.orderBy("dataset_id").collect()]
    assert values[0] > values[1] > values[2]
    with pytest.raises(ValueError, match="unknown"):
        registry().evaluate(real, {}, ["nothing"])


def test_search_grid_keeps_failures():
    def objective(p):
        if p["a"] == 2:
            raise ValueError
        return p["a"]

    assert audit.search_grid({"a": [1, 2, 3]}, objective) == [({"a": 3}, 3.0), ({"a": 1}, 1.0), ({"a": 2}, None)]


def test_restricted_choice():
    logits = np.array([9.0, 1.0, 5.0])
    assert models.restricted_choice(logits, np.array([1, 2])) == 2
    assert models.restricted_choice(logits, np.array([1]), 0.7) == 1


def test_vocabulary_file(spark, tmp_path):
    vocab = sequences.vocabulary(spark.createDataFrame([("a",), ("a",), ("b",)], "f string"), ["f"])
    files.save_vocabulary(vocab, str(tmp_path / "v"))
    lines = [line for p in sorted((tmp_path / "v").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "SPECIAL_[UNK]" and lines[-2:] == ["f_a", "f_b"]


def test_unknown_file_type(spark):
    with pytest.raises(ValueError, match="unsupported"):
        files.read_file(spark, "/nowhere/x.xyz")


def test_streaming_time_diff(spark, tmp_path):
    from trialspark.streaming.series import streaming_time_diff

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (2, "2024-01-02 00:00:00")], "u int, t string").select("u", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming_time_diff(stream, "u", "ts").writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("diffs").select("u", "total_seconds")) == [(1, 0), (1, 30), (2, 0)]
