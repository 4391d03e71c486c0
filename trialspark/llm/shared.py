"""What the operators of this subpackage share: shared folders, text batches, components.

Intermediate results that more than one job reads are written as Parquet below
``spark.checkpoint.dir`` (a folder that driver and executors share), which also
cuts lineage: a lost executor costs a re-read, not a recomputation.  Nothing is
written to machine-local folders.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.storage import materialise, release, remove, scratch, write_table

__all__ = ["materialise", "release", "remove", "scratch", "write_table"]

#: UTF-8 bytes of text that one vectorised step handles at a time (a longer text goes alone).
BATCH_BYTES = 1 << 20

#: Bytes of text that one fragment of a key space stands for, so that a fragment's pieces fit a worker at any size.
FRAGMENT_BYTES = 8 << 20


def fragments_for(docs: DataFrame) -> int:
    """Hash ranges to cut a key space into, by the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))


def local_filesystem(path: str):
    """File system and path for a URI, for files that executors write and read by themselves."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def documents_of(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def trim() -> None:
    """Give memory that nothing holds back to the system; workers live on after a task and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches holding about ``limit`` bytes of their ``text`` column, with these texts (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        sizes = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), [t or b"" for t in column.slice(at, to - at).to_pylist()]
            at = to
    trim()


def column_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class Forest:
    """Union-find over ids seen so far; roots are the smallest ids."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


#: Edges that one task contracts in memory at a time.
_EDGES_PER_STEP = 1 << 20
#: Fewer edges than this are contracted by one task to the end, in bounded memory.
_WHOLE = 1 << 19


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by stars of their local components (node, root), node > root."""
    forest, seen = Forest(), 0

    def out() -> pa.RecordBatch:
        nodes = np.fromiter(forest.parent, dtype=np.int64, count=len(forest.parent))
        roots = np.fromiter((forest.find(int(x)) for x in nodes), dtype=np.int64, count=len(nodes))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    for batch in batches:
        edges = np.stack([batch.column(k).to_numpy() for k in range(2)], 1)
        order = np.lexsort(edges.T)
        edges = edges[order][np.append(True, (np.diff(edges[order], axis=0) != 0).any(1))[: len(edges)]]
        for a, b in edges.tolist():
            forest.union(a, b)
        seen += batch.num_rows
        if seen >= _EDGES_PER_STEP:
            yield out()
            forest, seen = Forest(), 0
    if seen:
        yield out()


def _neighbours(edges: DataFrame, tag: str) -> DataFrame:
    """Nodes that have smaller neighbours: (a, up, inner) with these neighbours, at most one from each task that contracted, and whether the node has greater ones too."""
    ends = edges.union(edges.select("b", F.lit(None).cast("bigint")))
    nodes = ends.groupBy("a").agg(F.collect_set("b").alias("up"), F.max(F.col("b").isNull()).alias("inner"))
    return materialise(nodes.where(F.size("up") > 0), tag)


def _without_leaves(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, between the nodes that are no leaves: those of inner nodes, and from a leaf's smallest neighbour to its others."""
    least = F.array_min("up")
    each = nodes.select("a", "inner", least.alias("m"), F.explode(F.when(F.col("inner"), F.col("up")).otherwise(F.filter("up", lambda x: x > least))).alias("x"))
    return each.select(F.when(F.col("inner"), F.col("a")).otherwise(F.col("x")).alias("a"), F.when(F.col("inner"), F.col("x")).otherwise(F.col("m")).alias("b"))


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node reachable.

    ``edges`` has two bigint columns.  The edges that share a task are contracted
    first.  What is left of a small graph is contracted by one task.  Of a larger one
    the leaves, nodes that are the smaller end of no edge, are set aside, each with the
    smallest of its neighbours, to which its other neighbours are linked instead; the
    rest is contracted again.  Where that leaves more than half of the edges, a round
    links every node to the smallest neighbour of its neighbours (large star, small
    star).  At last the leaves get the components of what they hang on.  All state stays
    in tables in the shared folder.  Rounds grow with the logarithm of the longest path.
    Nodes without an edge do not appear.  A hub's edges are aggregated before the
    shuffle and joined with a join that splits skewed keys.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b")
    current = materialise(edges.mapInArrow(_contract, "a bigint, b bigint"), tag)
    hung: list[DataFrame] = []
    unsettled = True
    while unsettled:
        n = current.count()
        if n < _WHOLE:
            following = materialise(current.coalesce(1).mapInArrow(_contract, "a bigint, b bigint"), tag)
            release(current)
            current = following
            break
        nodes = _neighbours(current, tag)
        hung.append(nodes)
        following = materialise(_without_leaves(nodes).mapInArrow(_contract, "a bigint, b bigint"), tag)
        release(current)
        current = following
        if 2 * current.count() < n:
            continue
        # large star: every neighbour u > v of v, and v, goes to the smallest neighbour of v
        both = current.union(current.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(smallest, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest.where("v <> m").select("v", "m"))
        )
        # small star: every node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low.withColumnRenamed("a", "v"), F.col("a") == F.col("v"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        following = materialise(small, tag)
        # a star forest: nobody is both a leaf and a centre, and every leaf has one centre
        leaves = following.select("a")
        unsettled = following.select("b").join(leaves, F.col("b") == F.col("a"), "left_semi").limit(1).count() or (
            leaves.groupBy("a").count().where("count > 1").limit(1).count()
        )
        release(current)
        current = following
    for nodes in reversed(hung):
        leaves = nodes.where("not inner").select("a", F.array_min("up").alias("m"))
        found = leaves.join(current.select(F.col("a").alias("m"), "b"), "m", "left").select("a", F.coalesce("b", "m").alias("b"))
        following = materialise(found.union(current), tag)
        release(current, nodes)
        current = following
    out = current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
    out._scratch = current._scratch  # for release()
    return out
