"""Token-id store (operator 2): independent zstandard frames, seek table, checksums.

A store is a folder of shard files.  Layout of a shard:

    frame 0 | frame 1 | ... | seek table | footer

* A frame is one zstandard frame with the ids of one document as little-endian
  unsigned 32-bit integers; it can be decompressed alone.
* The seek table is one zstandard skippable frame (magic 0x184D2A5E) with an
  entry per document: doc_id (i64), first id's position in the shard (u64),
  number of ids (u32), byte length of the frame (u32), crc32 of the ids (u32).
* The footer is the last 16 bytes of that skippable frame: number of entries
  (u64), crc32 of the entries (u32) and the magic ``TSK1``.

Any zstandard decoder reads the frames of a shard and skips the table.  Documents
stand in ascending order of doc_id within a shard, and shards cover ascending,
disjoint ranges of doc_id, so the store as a whole is in that order.

Cases: a null or empty text has only the end id.  A null doc_id is kept and sorts
first.  Repeated doc_ids are repeated entries.  An empty table makes an empty
store.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm import bpe
from trialspark.llm.shared import column_of, local_filesystem, materialise, scratch, text_batches

END_ID = 0
SKIPPABLE_MAGIC = 0x184D2A5E
MAGIC = b"TSK1"
NULL_ID = -(1 << 63)  # how a null doc_id is written in the seek table
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n", "<u4"), ("size", "<u4"), ("crc", "<u4")])


class ShardWriter:
    """Appends frames to a binary file; ``close`` writes the seek table."""

    def __init__(self, sink):
        self.sink, self.entries, self.tokens = sink, [], 0

    def add(self, doc_id: int, frame: bytes, n: int, crc: int) -> None:
        self.sink.write(frame)
        self.entries.append((doc_id, self.tokens, n, len(frame), crc))
        self.tokens += n

    def close(self) -> None:
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        body = table + struct.pack("<QI", len(self.entries), zlib.crc32(table)) + MAGIC
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class ShardReader:
    """Random access to the documents of a shard; reads the table and the wanted frames only."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        count, crc, magic = struct.unpack("<QI4s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token shard, or cut short")
        length = count * ENTRY.itemsize
        source.seek(size - 16 - length)
        raw = source.read(length)
        if zlib.crc32(raw) != crc:
            raise ValueError("seek table is damaged")
        self.entries = np.frombuffer(raw, dtype=ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["size"], dtype=np.int64)])
        self.decoder = zstandard.ZstdDecompressor()

    def ids(self, i: int) -> bytes:
        """Ids of entry ``i`` as packed integers, after checking their checksum."""
        entry = self.entries[i]
        self.source.seek(int(self.offsets[i]))
        raw = self.decoder.decompress(self.source.read(int(entry["size"])), max_output_size=4 * int(entry["n"]))
        if zlib.crc32(raw) != int(entry["crc"]):
            raise ValueError(f"frame {i} is damaged")
        return raw


def write_store(docs: DataFrame, tokenizer_path: str, folder: str, level: int = 1) -> DataFrame:
    """Write the documents' ids below ``folder``; returns the manifest (path, first_id, last_id, n_docs, n_tokens).

    Documents are ranged by doc_id (rows of one id by a hash of their texts and a
    row number, so that repeated rows spread over shards) and each task encodes its range and writes one shard
    under a name of its own.  The manifest holds the names of the tasks that
    succeeded, so a retried or speculative attempt leaves at most an unlisted file.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_n")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, sink, name, first, last, count = None, None, "", None, None, 0
        fs, root = local_filesystem(folder)
        compress = zstandard.ZstdCompressor(level=level).compress
        end = np.array([END_ID], dtype="<u4").tobytes()
        enc = bpe.encoder(tokenizer_path, "<u4")
        for batch, texts in text_batches(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
            if writer is None:
                fs.create_dir(root, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.tok"
                sink = fs.open_output_stream(f"{root}/{name}")
                writer, first = ShardWriter(sink), ids[0]
            for doc, packed in zip(ids, enc.encode(texts), strict=True):
                packed += end
                writer.add(NULL_ID if doc is None else doc, compress(packed), len(packed) // 4, zlib.crc32(packed))
            count, last = count + len(ids), ids[-1]
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([count], pa.int64()), pa.array([writer.tokens], pa.int64())],
                names=["path", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    return materialise(ranged.mapInArrow(run, "path string, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint"), "manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document of a store, read back and checked: (doc_id, start, n_tokens, ids_crc32, shard).

    ``start`` counts the ids of all documents before it in the store.  The manifest
    has a row for each shard, so the running total over it stays small.
    """
    spark = manifest.sparkSession
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "path")
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shards = shards.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), column_of(batch, "base").tolist(), strict=True):
                fs, name = local_filesystem(path)
                with fs.open_input_file(name) as source:
                    reader = ShardReader(source, source.size())
                    for at in range(0, len(reader.entries), 10_000):
                        some = reader.entries[at : at + 10_000]
                        crc = [zlib.crc32(reader.ids(at + i)) for i in range(len(some))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(some["doc_id"].astype(np.int64), mask=some["doc_id"] == NULL_ID),
                                pa.array(some["start"].astype(np.int64) + base),
                                pa.array(some["n"].astype(np.int64)),
                                pa.array(crc, pa.int64()),
                                pa.array([name.rpartition("/")[2]] * len(some)),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                        )

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard string")


def op2_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from trialspark.llm.shared import documents_of

    path = tokenizer_path or bpe.default_tokenizer_path()
    manifest = write_store(documents_of(spark, sf_dir), path, scratch(spark, "token-store"))
    return read_store(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
