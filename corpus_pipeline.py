"""A corpus pipeline of five of the operators: quality, near duplicates, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents; all but the last return the
columns of ``documents``.

1. quality_classifier: documents scored below the threshold go.
2. ngram_join: of each group of near duplicates (Jaccard similarity of five-word
   shingles 0.8 or more) the smallest doc_id stays.
3. substring_dedup: passages that an earlier document has are cut out of later ones.
4. secret_scan: secrets are replaced by a placeholder.
5. best_fit_packing: what is left is packed into bins, one row for each piece.

Rows without doc_id pass the second and third stage unchanged, and of rows that
repeat a doc_id the second stage keeps one.  Columns beside those of ``documents``
are carried through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm import ngram_join, packing, passages, quality, secret_scan
from trialspark.llm.shared import free_name, materialise, release, scratch


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = free_name(docs, "_score")
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.similarity_components(docs.select("doc_id", "text"), size=5, percent=80)
    stay = materialise(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    release(found)
    rank = free_name(docs, "_rank")
    one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = docs.join(stay.hint("merge"), "doc_id").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(passages.remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.redact(docs, scratch(spark, "ledger"), secret_scan.RULES + secret_scan.MORE_RULES))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_lengths(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
