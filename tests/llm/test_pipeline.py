"""The pipeline's stages, each on its own input, against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus_operators import linked, spans_of, words_of
from trialspark.llm import bpe, packing, quality
from trialspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    from trialspark.llm.shared import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name].dtypes == steps["input"].dtypes


def test_quality_stage_drops_bad_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(steps["quality_classifier"])
    good, bad = [d for d, q in labels.items() if q], [d for d, q in labels.items() if not q]
    assert sum(d in kept for d in good) / len(good) > 0.98
    assert sum(d in kept for d in bad) / len(bad) < 0.05
    before = rows(steps["input"])
    assert all(before[d] == r for d, r in kept.items())
    assert quality.THRESHOLD == 0.3


def test_one_document_of_each_group_stays(steps):
    before = rows(steps["quality_classifier"])
    want = {d for d, (_, c) in linked([(d, r["text"]) for d, r in before.items()], 5, 80).items() if d == c}
    assert set(rows(steps["ngram_join"])) == want


def test_no_long_passage_is_left_twice(steps):
    before, after = rows(steps["ngram_join"]), rows(steps["substring_dedup"])
    assert set(before) == set(after)
    seen = {}
    for d, r in after.items():
        assert r["n_chars"] == len(r["text"]) <= len(before[d]["text"])
        w = words_of(r["text"])
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), d) == d
    assert any(len(after[d]["text"]) < len(before[d]["text"]) for d in after)


def test_no_secret_is_left(steps):
    before, after = rows(steps["substring_dedup"]), rows(steps["secret_scan"])
    assert set(before) == set(after)
    assert any("[REDACTED]" in r["text"] for r in after.values())
    for d, r in after.items():
        if not spans_of(before[d]["text"]):
            assert r["text"] == before[d]["text"]
        for s in filter(None, spans_of(r["text"]).split(",")):
            assert re.search(r"REDACTED", r["text"][max(0, int(s.split(":")[1]) - 12) : int(s.split(":")[2]) + 12])


def test_everything_is_packed(steps):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_tokenizer_path())
    want = {d: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for d, r in rows(steps["secret_scan"]).items()}
    packed = {r["doc_id"]: r["n"] for r in steps["best_fit_packing"].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert packed == want
    assert steps["best_fit_packing"].groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Documents with nulls, empty and very long texts, repeats and columns of clashing names."""
    root = tmp_path_factory.mktemp("odd")
    some = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    long = " ".join(f"w{k * 7919 % 400_000}" for k in range(400_000))
    data = [*some, (None, None), (None, "no id"), (900, ""), (901, None), (902, long), (903, long), some[0], some[0], (904, "x" * 2_000_000)]
    odd = spark.createDataFrame([(d, t, "en", "s", 0, 0.5, "a", "b", 1, "c", 7) for d, t in data], "doc_id bigint, text string, lang string, source string, n_chars int, score double, _cuts string, _blob string, _r int, print string, cluster int")
    odd.write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return str(root), len(data)


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op2_token_store", "op3_media_columns", "op4_quality", "op5_token_counts", "op6_ngram_join", "op7_substring_dedup", "op8_best_fit_packing", "op9_secret_scan"])
def test_queries_take_odd_documents(spark, odd_dir, name):
    root, n = odd_dir
    out = QUERIES[name](spark, root)
    if name == "op7_substring_dedup":
        assert {(r["doc_id"], r["kept_in"]) for r in out.collect()} >= {(903, 902)}
    elif name == "op8_best_fit_packing":
        assert out.where("piece = 0").count() == n and out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY
    else:
        assert out.count() == n


def test_stages_carry_clashing_columns(spark, odd_dir):
    from trialspark.llm.shared import materialise

    root, _ = odd_dir
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, root), "odd")
        assert name == "best_fit_packing" or docs.columns == names
    assert docs.count()


def test_stages_take_empty_and_odd_documents(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "text without an id", None, "s", 5)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() <= len(data) or name == "best_fit_packing"
