"""N-gram Jaccard join by vertical partitioning (operator 6).

The word n-grams of all documents have one global order, the order of their
hashes cut into fragments of equal range.  Each fragment is handled on its own
and sees the pieces of all documents that fall into it; what fragments find is
summed per document or per pair:

1. Documents with the same set are one class; only classes are compared.
2. The fragments of the first third of the order count, for every class, the
   n-grams that no other class has.  A class with more than 100 - percent per
   cent of such n-grams cannot be similar to any other and leaves.
3. Of the classes that stay, the fragments of the whole order count in how many
   classes each n-gram occurs.  Ordered by that count, two similar classes share
   an n-gram among their first ``(100 - percent) * n / 100 + 1``; classes that do
   so are candidates, and components of candidates are clusters.
4. Clusters are compared exactly in bounded cells: every fragment of the order
   counts the partial overlaps of a cell's pairs on its own, and the partial
   overlaps are summed per pair (``blocks``).

Every step is exact: no n-gram, document or partner is dropped by frequency or
number.  Rows that move are packed pieces of sets, most of them in step 2, which
moves 4 bytes for a third of the n-grams.

Cases: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than the n-gram has its whole
sequence as its only n-gram.  Rows with the same doc_id are one node, so what
links one of them links all.  A row without doc_id keeps a null component.
n-grams and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.blocks import link_clusters
from trialspark.llm.hashing import mix64, shingle_sets
from trialspark.llm.shared import column_of, connected_components, documents_of, fragments_for, materialise, release, text_batches

#: The order's fragments that step 2 reads: one in so many.
REGION = 3


def _signatures(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every set."""
    out = []
    n = np.diff(off).astype(np.uint64)
    for salt in (0x1234567, 0x89ABCDEF1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix64(total[off[1:]] - total[off[:-1]] + n * np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of equal values."""
    if not len(x):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return starts, np.append(starts[1:], len(x))


def pack(owner_ids: np.ndarray, owner: np.ndarray, fragment: np.ndarray, tokens: np.ndarray, width: str) -> Iterator[tuple[int, bytes]]:
    """Pieces of sets by fragment, packed: number of owners, their ids, tokens each has, tokens."""
    order = np.argsort(fragment, kind="stable")
    owner, fragment, tokens = owner[order], fragment[order], tokens[order].astype(width)
    for a, b in zip(*_runs(fragment), strict=True):
        o = owner[a:b]
        heads, stops = _runs(o)
        counts = (stops - heads).astype("<u4")
        head = np.array([len(heads)], dtype="<u4").tobytes()
        yield int(fragment[a]), head + owner_ids[o[heads]].astype("<i8").tobytes() + counts.tobytes() + tokens[a:b].tobytes()


def unpack(blobs: list[bytes], width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, token counts and tokens of packed pieces, one after the other."""
    ids, counts, tokens = [], [], []
    for blob in blobs:
        k = int(np.frombuffer(blob, "<u4", 1)[0])
        ids.append(np.frombuffer(blob, "<i8", k, 4))
        counts.append(np.frombuffer(blob, "<u4", k, 4 + 8 * k))
        tokens.append(np.frombuffer(blob, width, -1, 4 + 12 * k))
    return np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.concatenate(tokens)


def first_of_each(ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and token of every piece, copies of the same set left out."""
    _, first = np.unique(ids, return_index=True)
    keep = np.zeros(len(ids), dtype=bool)
    keep[first] = True
    return np.repeat(ids[keep], counts[keep]), tokens[np.repeat(keep, counts)]


def shared_mask(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token occurrence, the number of occurrences of that token."""
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    starts, stops = _runs(t)
    runs = stops - starts
    df = np.empty(len(t), dtype=np.int64)
    df[order] = np.repeat(runs, runs)
    return df > 1, df


def _first_pass(size: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            flat, off = shingle_sets(texts, size)
            s1, s2 = _signatures(flat, off)
            owner = np.repeat(np.arange(len(texts)), np.diff(off))
            fragment = ((flat >> np.uint64(32)) * np.uint64(fragments * REGION)) >> np.uint64(32)
            inside = fragment < fragments
            region = np.bincount(owner[inside], minlength=len(texts))
            pieces = list(pack(s1, owner[inside], fragment[inside].astype(np.int64), flat[inside] & np.uint64(0xFFFFFFFF), "<u4"))
            k, m = len(texts), len(pieces)
            nothing = pa.nulls(m, pa.int64())
            columns = [
                pa.array([-1] * k + [f for f, _ in pieces], pa.int32()),
                pa.chunked_array([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), nothing]).combine_chunks(),
                *(pa.chunked_array([pa.array(x, pa.int64()), nothing]).combine_chunks() for x in (np.diff(off), region, s1, s2)),
                pa.array([None] * k + [b for _, b in pieces], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["fragment", "doc_id", "n", "region", "uid", "check", "piece"])

    return run


def _count_shared(table: pa.Table) -> pa.Table:
    owner, tokens = first_of_each(*unpack(table.column("piece").to_pylist(), "<u4"))
    shared, _ = shared_mask(tokens)
    ids, counts = np.unique(owner[shared], return_counts=True)
    return pa.table({"uid": pa.array(ids, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _second_pass(size: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            flat, off = shingle_sets(texts, size)
            uid, check = _signatures(flat, off)
            same = (uid == column_of(batch, "uid")) & (check == column_of(batch, "check"))
            owner = np.repeat(np.arange(len(texts)), np.diff(off))
            keep = same[owner]
            fragment = (((flat >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
            pieces = list(pack(uid, owner[keep], fragment[keep], flat[keep], "<u8"))
            whole = [i for i in range(len(texts)) if same[i]]
            k, m = len(whole), len(pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * k + [f for f, _ in pieces], pa.int32()),
                    pa.chunked_array([pa.array(uid[whole], pa.int64()), pa.nulls(m, pa.int64())]).combine_chunks(),
                    pa.array([flat[off[i] : off[i + 1]].astype("<u8").tobytes() for i in whole] + [b for _, b in pieces], pa.binary()),
                ],
                names=["fragment", "uid", "items"],
            )

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Shared tokens of every class in a fragment, each with its frequency, packed."""
    owner, tokens = first_of_each(*unpack(table.column("items").to_pylist(), "<u8"))
    shared, df = shared_mask(tokens)
    owner, tokens, df = owner[shared], tokens[shared], df[shared]
    order = np.argsort(owner, kind="stable")
    owner, tokens, df = owner[order], tokens[order], df[order]
    heads, stops = _runs(owner)
    pieces = [df[a:b].astype("<u8").tobytes() + tokens[a:b].astype("<u8").tobytes() for a, b in zip(heads, stops, strict=True)]
    return pa.table({"uid": pa.array(owner[heads], pa.int64()), "piece": pa.array(pieces, pa.binary())})


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_token, out_uid = [], []
            for uid, n, pieces in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                halves = [np.frombuffer(p, "<u8").reshape(2, -1) for p in pieces]
                df, tokens = np.concatenate(halves, axis=1)
                # n-grams of this class alone come first in the order and can be shared with nobody
                take = (100 - percent) * n // 100 + 1 - (n - len(tokens))
                if take > 0:
                    order = np.lexsort((tokens, df))[:take]
                    out_token.append(tokens[order])
                    out_uid.append(np.full(len(order), uid, dtype=np.int64))
            if out_uid:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_token).view(np.int64)), pa.array(np.concatenate(out_uid))], names=["token", "uid"]
                )

    return run


def similarity_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of ``size``-word shingles; component_id is the smallest doc_id that links reach.
    """
    docs = docs.select("doc_id", "text")
    fragments = fragments_for(docs)
    first = materialise(
        docs.mapInArrow(_first_pass(size, fragments), "fragment int, doc_id bigint, n bigint, region bigint, uid bigint, check bigint, piece binary"),
        "ngram-pieces",
    )
    rows = materialise(first.where("fragment < 0").select("doc_id", "n", "region", "uid", "check"), "ngram-documents")
    counts = first.where("fragment >= 0").select("fragment", "piece").groupBy("fragment").applyInArrow(_count_shared, "uid bigint, shared bigint")
    counts = counts.groupBy("uid").agg(F.sum("shared").alias("shared"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("uid", "check", "n", "region").agg(F.min("doc_id").alias("doc_id"))
    alone = F.col("region") - F.coalesce("shared", F.lit(0))
    stay = materialise(
        classes.join(counts, "uid", "left").where(100 * alone <= (100 - percent) * F.col("n")).select("doc_id", "uid", "check", "n"), "ngram-classes"
    )
    release(first)
    sets = materialise(
        docs.join(stay.select("doc_id", "uid", "check").hint("merge"), "doc_id").mapInArrow(_second_pass(size, fragments), "fragment int, uid bigint, items binary").where("items is not null"),
        "ngram-sets",
    )
    pieces = sets.where("fragment >= 0").groupBy("fragment").applyInArrow(_frequencies, "uid bigint, piece binary")
    pieces = pieces.groupBy("uid").agg(F.collect_list("piece").alias("pieces"))
    prefix = pieces.join(stay.select("uid", "n").distinct(), "uid").select("uid", "n", "pieces").mapInArrow(_prefixes(percent), "token bigint, uid bigint")
    prefix = materialise(prefix, "ngram-prefixes")
    # a star for every n-gram: the smallest class that has it among its first
    centre = prefix.groupBy("token").agg(F.min("uid").alias("centre"), F.max("uid").alias("other")).where("centre <> other")
    centre = materialise(centre.select("token", "centre"), "ngram-centres")  # so that the join can split a common n-gram
    clusters = connected_components(prefix.join(centre, "token").where("uid <> centre").select("uid", "centre"))
    release(stay, prefix, centre)
    whole = sets.where("fragment < 0").select("uid", "items").dropDuplicates(["uid"])
    members = materialise(clusters.select(F.col("component").alias("cluster"), F.col("node").alias("uid")).join(whole, "uid"), "ngram-members")
    release(sets, clusters)
    links = link_clusters(members, percent)
    release(members)
    # rows that share a doc_id are one document, whatever their sets
    several = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a <> b")
    same_id = rows.join(several.select("doc_id", "a"), "doc_id").where("uid <> a and n > 0").select("a", F.col("uid").alias("b"))
    labels = connected_components(links.union(same_id))
    smallest = rows.where("doc_id is not null and n > 0").groupBy("uid").agg(F.min("doc_id").alias("smallest"))
    named = smallest.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    named = materialise(named, "ngram-labels")
    release(links, labels)
    final = named.join(named.groupBy("component").agg(F.min("smallest").alias("component_id")), "component").select("uid", "component_id")
    out = rows.select("doc_id", "n", "uid").join(final, "uid", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("bigint").alias("component_id")), "ngram-components")
    release(rows, named)
    return out


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents_of(spark, sf_dir), size=4, percent=85)
