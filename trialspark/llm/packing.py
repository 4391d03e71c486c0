"""Best-fit packing (operator 8): documents into bins, under conflicts.

A bin holds at most ``CAPACITY`` tokens, at most one document of a duplicate
cluster and at most ``PER_SOURCE`` documents of a source.  Documents go by
decreasing length; the bins of a shard stand in the order of their free space and
carry bitmaps of their sources (one bitmap for each document of a source allowed)
and of their duplicate clusters.  The search starts at the first bin that is
large enough and goes on to the next larger one until the bitmaps allow the
document; the bin it finds is the tightest compatible one.  If there is none, a
new bin is opened.

Documents are dealt at random to shards of about ``SHARD`` items, each packed by
one task, so memory is bounded and a source with a third of all documents is
spread over all shards.  Nothing is dropped: a document longer than a bin is cut
into pieces of a bin's size and a rest, and only the rest shares its bin.

Cases: a document of no tokens, null ids, null sources (a source of its own) and
null clusters (in conflict with nobody) are packed like others; lengths that are
null or below zero count as zero; ties in length go by cluster, then doc_id;
repeated rows are packed each, dealt to all shards; a very long text is encoded
whole and cut into pieces; extra columns are ignored.

Tokens are the ids of the byte-level BPE, with an end id for each document.  A
duplicate cluster of the query is a group of byte-equal texts: ``pack`` takes any
cluster, and in the pipeline near duplicates are gone before this stage.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import bpe
from trialspark.llm.shared import documents_of, materialise, text_batches

CAPACITY = 4096
PER_SOURCE = 4
SHARD = 1024


class Bins:
    """Open bins of a shard, ordered by free space."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (free space, bin)
        self.sources: list[list[int]] = []  # bitmap k: sources with more than k documents in the bin
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin of a document and its offset there; ``source`` and ``cluster`` are bits (cluster 0: none)."""
        at = bisect_left(self.order, (length, -1))
        full = self.per_source - 1
        while at < len(self.order):
            free, b = self.order[at]
            if not self.sources[b][full] & source and not self.clusters[b] & cluster:
                del self.order[at]
                break
            at += 1  # the successor: the next larger free space
        else:
            free, b = self.capacity, len(self.used)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.used.append(0)
        maps = self.sources[b]
        level = 0
        while maps[level] & source:
            level += 1
        maps[level] |= source
        self.clusters[b] |= cluster
        offset = self.capacity - free
        self.used[b] += length
        insort(self.order, (free - length, b))
        return b, offset


def pack_items(items: list[tuple[int, object, object]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """Bin and offset of every item (length, source, cluster), in the given order."""
    bins = Bins(capacity, per_source)
    source_bit: dict[object, int] = {}
    seen: dict[object, int] = {}
    for _, _, cluster in items:
        seen[cluster] = seen.get(cluster, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    return [
        bins.place(length, source_bit.setdefault(source, 1 << len(source_bit)), cluster_bit.get(cluster, 0))
        for length, source, cluster in items
    ]


def _pack_shard(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(
            table.to_pylist(),
            key=lambda r: (-r["n_tokens"], r["cluster"] is None, r["cluster"] or 0, r["doc_id"] is None, r["doc_id"] or 0, r["piece"]),
        )
        placed = pack_items([(r["n_tokens"], r["source"], r["cluster"]) for r in rows], capacity, per_source)
        fill: dict[int, int] = {}
        for r, (b, _) in zip(rows, placed, strict=True):
            fill[b] = fill.get(b, 0) + r["n_tokens"]
        columns = {
            "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
            "piece": pa.array([r["piece"] for r in rows], pa.int32()),
            "start": pa.array([r["start"] for r in rows], pa.int64()),
            "n_tokens": pa.array([r["n_tokens"] for r in rows], pa.int64()),
            "bin_id": pa.array([(r["shard"] << 32) + b for r, (b, _) in zip(rows, placed, strict=True)], pa.int64()),
            "bin_offset": pa.array([o for _, o in placed], pa.int64()),
            "bin_tokens": pa.array([fill[b] for b, _ in placed], pa.int64()),
        }
        return pa.table(columns)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Bins of documents (doc_id, source, cluster, n_tokens): a row for each piece of each document.

    Returns doc_id, piece, start (first token of the piece in its document),
    n_tokens, bin_id, bin_offset and bin_tokens (tokens in the bin).
    """
    length = F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    rows = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("bigint").alias("cluster"), length.alias("length"), F.monotonically_increasing_id().alias("row"))
    pieces = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    rows = rows.withColumn("start", F.col("piece").cast("bigint") * capacity)
    rows = rows.withColumn("n_tokens", F.least(F.col("length") - F.col("start"), F.lit(capacity).cast("bigint"))).drop("length")
    shards = max(1, -(-items.count() // SHARD))
    # the row number, the same in every reading of a written table, spreads rows that are equal in all columns
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n_tokens", "piece", "row"), F.lit(shards)).cast("bigint")).drop("row")
    return rows.groupBy("shard").applyInArrow(
        _pack_shard(capacity, per_source),
        "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_tokens bigint",
    )


def with_lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Documents as items, written: the ids of the whole text and an end id are the tokens, equal texts are a duplicate cluster."""
    path = tokenizer_path or bpe.default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, "<u4")
        for batch, texts in text_batches(batches):
            counts = np.array([len(ids) // 4 + 1 for ids in enc.encode(texts)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts)], names=["doc_id", "source", "cluster", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), "text"
    )
    return materialise(rows.mapInArrow(run, "doc_id bigint, source string, cluster bigint, n_tokens bigint"), "lengths")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_lengths(documents_of(spark, sf_dir, ("doc_id", "source", "text"))))
