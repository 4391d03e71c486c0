"""Token counts (operator 5): separator scan over flat, unindexed token files.

A flat token file is a run of little-endian unsigned 16-bit ids in which an
end-of-document id closes every document; nothing says where documents start.
The files are cut into blocks of a fixed number of ids that are scanned in any
order by any task: a block reports the lengths of the documents that end in it
(the first one only as far as it lies in the block) and the number of ids after
its last separator.  The separator must not come from a text, so texts are encoded
with special tokens as plain text (``<|endoftext|>`` in a text is several ids).
A prefix scan over the blocks of a file then carries the
open length into each first document, and a running count of separators gives
every document its ordinal.

Cases: a null or empty text is a document of no ids (count 1 with its
separator); a block without a separator only lengthens the open document; ids
after the last separator of a file belong to no document and are reported by
``open_tail``.  A null doc_id, repeated rows and further columns are kept or
ignored alike.  An empty table makes no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm import bpe
from trialspark.llm.shared import documents_of, local_filesystem, materialise, scratch, text_batches

#: Ids in a block; a task holds one block in memory at a time.
BLOCK_IDS = 1 << 21


def write_flat(docs: DataFrame, tokenizer_path: str, separator: int, folder: str) -> DataFrame:
    """Write one flat token file per task; returns (path, ordinal, doc_id), the documents in file order.

    Files carry a name of their own, so a retried task leaves an unlisted file at
    most.  The returned rows only name the documents; they hold no lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer_path, "<u2", verbatim=True)
        end = np.array([separator], dtype="<u2").tobytes()
        fs, root = local_filesystem(folder)
        sink, path, written = None, "", 0
        for batch, texts in text_batches(batches):
            if sink is None:
                fs.create_dir(root, recursive=True)
                path = f"flat-{uuid.uuid4().hex}.u16"
                sink = fs.open_output_stream(f"{root}/{path}")
            for ids in enc.encode(texts):
                sink.write(ids + end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{path}"] * len(texts)),
                    pa.array(np.arange(written, written + len(texts), dtype=np.int64)),
                    batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                ],
                names=["path", "ordinal", "doc_id"],
            )
            written += len(texts)
        if sink is not None:
            sink.close()

    return materialise(docs.select("doc_id", "text").mapInArrow(run, "path string, ordinal bigint, doc_id bigint"), "flat-documents")


def scan_block(ids: np.ndarray, separator: int) -> tuple[np.ndarray, int]:
    """Lengths of the documents that end in a block, separators included, and the ids after the last separator."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return np.empty(0, dtype=np.int64), len(ids)
    return np.diff(at, prepend=-1), len(ids) - 1 - int(at[-1])


def scan_files(paths: DataFrame, separator: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of flat files: (path, block, lengths, tail, carried, before).

    ``carried`` is the open length that enters the block from those before it and
    ``before`` the number of documents that ended in them.
    """
    spark = paths.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, name = local_filesystem(path)
                out.append(-(-(fs.get_file_info(name).size // 2) // block_ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["path", "blocks"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = local_filesystem(path)
                with fs.open_input_file(name) as source:
                    source.seek(2 * block * block_ids)
                    lengths, tail = scan_block(np.frombuffer(source.read(2 * block_ids), dtype="<u2"), separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([lengths], pa.list_(pa.int64())), pa.array([tail], pa.int64())],
                    names=["path", "block", "lengths", "tail"],
                )

    blocks = paths.mapInArrow(sizes, "path string, blocks bigint").where("blocks > 0")
    blocks = blocks.select("path", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition(tasks, "path", "block")
    scanned = materialise(blocks.mapInArrow(scan, "path string, block bigint, lengths array<bigint>, tail bigint"), "blocks")
    # prefix scan: the open length before a block is the sum of the tails since the last block with a separator, that one included
    order = Window.partitionBy("path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.size("lengths") > 0
    runs = scanned.withColumn("run", F.coalesce(F.sum(ended.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    runs = runs.withColumn("open_to_here", F.sum("tail").over(Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.withColumn("carried", F.coalesce(F.lag("open_to_here").over(order), F.lit(0)))
        .withColumn("before", F.coalesce(F.sum(F.size("lengths").cast("bigint")).over(earlier), F.lit(0)))
        .select("path", "block", "lengths", "tail", "carried", "before")
    )


def document_lengths(blocks: DataFrame) -> DataFrame:
    """Every document of the scanned files: (path, ordinal, n_tokens), separators included."""
    each = blocks.select("path", "carried", "before", F.posexplode("lengths").alias("i", "n"))
    return each.select("path", (F.col("before") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("n") + F.col("carried")).otherwise(F.col("n")).alias("n_tokens"))


def open_tail(blocks: DataFrame) -> DataFrame:
    """Ids after the last separator of every file: (path, n_tokens)."""
    last = blocks.groupBy("path").agg(F.max_by(F.when(F.size("lengths") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carried")), "block").alias("n_tokens"))
    return last.where("n_tokens > 0")


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, separator: int = 50256) -> DataFrame:
    """Number of ids of every document, its end id included, from flat token files."""
    named = write_flat(documents_of(spark, sf_dir), tokenizer_path or bpe.default_tokenizer_path(), separator, scratch(spark, "flat"))
    blocks = scan_files(named.select("path").distinct(), separator)
    return named.join(document_lengths(blocks), ["path", "ordinal"]).select("doc_id", "n_tokens")
