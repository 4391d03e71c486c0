"""Exact linking of sets by vertical partitioning: who is similar to whom, without listing pairs.

Items that might be similar share a *cluster*.  A cluster is compared in cells of
bounded size and a cell reports only a spanning forest of the links in it, so a
group of copies costs as many rows as it has members.

* Clusters of at most ``CELL`` items are one cell each.
* Larger clusters first go through random cells of several deals.  Items that are linked
  by then need no comparison among themselves; every item outside the cluster's
  largest component so far is compared with all items of the cluster, in cells of
  ``CELL`` by ``CELL`` items.  Nothing is dropped: a pair is left out only where
  both ends are known to be in one component.

The order of all tokens, that of their hashes, is cut into ranges, the same for
all cells.  Each (cell, range) is a group of its own, which may run anywhere: it
counts the partial overlaps of the cell's pairs in that range, all pairs at once
as a matrix product.  The partial overlaps of a cell, packed, then meet again and
are summed per pair, and only the sums are held against the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.shared import Forest, connected_components, materialise, release, trim

#: Items on a side of a cell.
CELL = 384
#: Distinct tokens that one matrix product takes.
FRAGMENT = 8192
#: Deals of random cells for larger clusters.
ROUNDS = 2
#: Ranges of the global order of 64-bit tokens.
RANGES = 4

EDGE = "a bigint, b bigint"
#: Bytes of packed overlaps that go out together.
_HELD = 4 << 20


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set; without columns, of all pairs of rows."""
    sides = [rows] if cols is None else [rows, cols]
    total = np.zeros((len(rows), len(sides[-1])), dtype=np.float32)
    flat = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in sides]
    if cols is None:
        shared, often = np.unique(flat[0], return_counts=True)
        shared = shared[often > 1]
    else:
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(shared):
        return total
    places = []
    for tokens, side in zip(flat, sides, strict=True):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(shared, tokens)
        at[at == len(shared)] = 0
        hit = shared[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for low in range(0, len(shared), FRAGMENT):
        width = min(FRAGMENT, len(shared) - low)
        matrices = []
        for (at, owner), side in zip(places, sides, strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((len(side), width), dtype=np.float32)
            m[owner[a:b], at[a:b] - low] = 1
            matrices.append(m)
        total += matrices[0] @ matrices[-1].T  # exact in 24 bits
    return total


def _spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, root) that connect what the links ids[a]-ids[b] connect."""
    forest = Forest()
    for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
        forest.union(x, y)
    nodes = [x for x in forest.parent if forest.find(x) != x]
    return np.array(nodes, dtype=np.int64), np.array([forest.find(x) for x in nodes], dtype=np.int64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of complete groups; rows with the same first ``keys`` columns arrive in a row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = [batch.column(k).to_numpy() for k in range(keys)]
        last = int(_heads(*ends)[-1])
        first = [held[0].column(k)[0].as_py() for k in range(keys)]
        if last or any(int(e[-1]) != f for e, f in zip(ends, first, strict=True)):
            done = [*held[:-1], batch.slice(0, last)]
            yield pa.Table.from_batches(done)
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    trim()


@lru_cache(maxsize=CELL + 1)
def _upper(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``m`` items."""
    return np.triu_indices(m, 1)


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, rows: np.ndarray, kind: str, width: int) -> np.ndarray:
    """Rows of a matrix from binaries of one length, without an object for each."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)
    size = width * np.dtype(kind).itemsize
    return np.ascontiguousarray(data[offsets[rows].astype(np.int64)[:, None] + np.arange(size)]).view(kind)


def _cut(width: str, ranges: int):
    """The pieces of every set in each range of the global order, empty ones too."""
    kind = np.dtype(width)
    bounds = np.array([k * ((1 << 8 * kind.itemsize) // ranges) for k in range(1, ranges)], dtype=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, side, uid, n = (np.repeat(batch.column(k).to_numpy(), ranges) for k in range(4))
            pieces = []
            for raw in batch.column(4).to_pylist():
                x = np.frombuffer(raw, dtype=width)
                pieces += [p.tobytes() for p in np.split(x, np.searchsorted(x, bounds))]
            part = np.tile(np.arange(ranges, dtype=np.int64), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (cell, part, side, uid, n)), pa.array(pieces, pa.binary())], names=["cell", "part", "side", "uid", "n", "piece"])

    return run


def _count(width: str):
    """Partial overlaps of the pairs of every (cell, range), packed: of all pairs, or of rows (side 0) with columns (side 1)."""
    names, kinds = ["cell", "rows", "ids", "sizes", "partial"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            cell, part, side, uid, n = (table.column(k).to_numpy() for k in range(5))
            sets = [np.frombuffer(s, dtype=width) for s in table.column(5).to_pylist()]
            head = _heads(cell, part)
            size = np.diff(np.append(head, len(cell)))
            two = head[(size == 2) & (side[head] == 2)]
            if len(two):  # cells of two items, all at once
                both = (two[:, None] + np.arange(2)).ravel()
                tokens = np.concatenate([sets[k] for k in both])
                owner = np.repeat(np.repeat(np.arange(len(two)), 2), [len(sets[k]) for k in both])
                order = np.lexsort((tokens, owner))
                tokens, owner = tokens[order], owner[order]
                twice = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
                inter = np.bincount(owner[1:][twice], minlength=len(two)).astype("<u4")
                two, inter = two[inter > 0], inter[inter > 0]
                pairs = two[:, None] + np.arange(2)
                yield pa.RecordBatch.from_arrays([pa.array(cell[two]), pa.array(np.full(len(two), -1)), _packed(uid[pairs]), _packed(n[pairs]), _packed(inter[:, None])], names=names)
            out: list[list] = [[] for _ in names]
            held = 0
            more = np.flatnonzero((size > 2) | ((size > 1) & (side[head] != 2)))
            for h, m in zip(head[more].tolist(), size[more].tolist(), strict=True):
                some, rows = sets[h : h + m], -1
                if side[h] == 2:
                    counts = overlaps(some)[_upper(m)]
                else:
                    rows = int((side[h : h + m] == 0).sum())
                    if rows in (0, m):
                        continue
                    counts = overlaps(some[:rows], some[rows:]).ravel()
                if not counts.any():
                    continue
                for column, x in zip(out, (cell[h], rows, uid[h : h + m].tobytes(), n[h : h + m].tobytes(), counts.astype("<u4").tobytes()), strict=True):
                    column.append(x)
                held += 4 * len(counts)
                if held > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return run


def _sum(percent: int):
    """Links of every cell from the sums of its partial overlaps."""

    def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (inter > 0) & (100 * inter >= percent * (n + m - inter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            cell, rows = table.column(0).to_numpy(), table.column(1).to_numpy()
            head = _heads(cell)
            stop = np.append(head[1:], len(cell))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            pair = (rows < 0) & (pc.binary_length(table.column(4)).to_numpy() == 4)
            if pair.any():
                of, first = np.flatnonzero(pair), head[pair[head]]
                sums = np.bincount(np.searchsorted(head, of, side="right") - 1, weights=_unpacked(table.column(4), of, "<u4", 1)[:, 0], minlength=len(head))
                ends, n = (_unpacked(table.column(k), first, "<i8", 2) for k in (2, 3))
                good = linked(sums[pair[head]], n[:, 0], n[:, 1])
                found.append((ends[good].max(1), ends[good].min(1)))
            for h, s in zip(head[~pair[head]].tolist(), stop[~pair[head]].tolist(), strict=True):
                uid, n = (np.frombuffer(table.column(k)[h].as_py(), "<i8") for k in (2, 3))
                inter = np.zeros(1, dtype=np.int64)
                for k in range(h, s):
                    inter = inter + np.frombuffer(table.column(4)[k].as_py(), "<u4")
                if rows[h] < 0:
                    a, b = _upper(len(uid))
                else:
                    a, b = (x.ravel() for x in np.meshgrid(np.arange(rows[h]), np.arange(rows[h], len(uid)), indexing="ij"))
                good = linked(inter, n[a], n[b])
                if good.any():
                    found.append(_spanning(uid, a[good], b[good]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def link_cells(cells: DataFrame, percent: int, width: str, ranges: int) -> DataFrame:
    """Links within cells of bounded size; ``cells`` has cell, side (2: all pairs; 0 and 1: rows and columns), uid and items."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = (F.octet_length("items") / np.dtype(width).itemsize).cast("bigint")
    rows = cells.select("cell", F.col("side").cast("bigint").alias("side"), "uid", n.alias("n"), "items")
    if ranges > 1:
        rows = rows.mapInArrow(_cut(width, ranges), "cell bigint, part bigint, side bigint, uid bigint, n bigint, piece binary")
    else:
        rows = rows.select("cell", F.lit(0).cast("bigint").alias("part"), "side", "uid", "n", F.col("items").alias("piece"))
    dealt = rows.repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "side", "uid")
    count, total = _count(width), _sum(percent)
    if ranges == 1:  # a cell's only range holds its sums
        return materialise(dealt.mapInArrow(lambda batches: total(count(batches)), EDGE), "links")
    partial = dealt.mapInArrow(count, "cell bigint, rows bigint, ids binary, sizes binary, partial binary")
    return materialise(partial.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(total, EDGE), "links")


def link_clusters(members: DataFrame, percent: int, width: str = "<u8", ranges: int = RANGES) -> DataFrame:
    """Links (a, b) that connect all similar items of each cluster: 100 * intersection >= percent * union.

    ``members`` has cluster, uid (bigint) and items (sorted distinct unsigned 64-bit
    integers, packed; ``width`` names another type).  An item may be in several clusters.  The result spans the
    components of the similarity graph within clusters; it does not list all links.
    """
    members = members.select("cluster", "uid", "items")
    as_cells = lambda df: df.withColumnRenamed("cluster", "cell").withColumn("side", F.lit(2))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    large_sizes = materialise(sizes.where(F.col("size") > CELL), "large-clusters")
    if not large_sizes.limit(1).count():
        release(large_sizes)
        return link_cells(as_cells(members), percent, width, ranges)
    large = materialise(members.join(large_sizes, "cluster").select("cluster", "uid", "items", "size"), "large-members")
    chunks = F.ceil(F.col("size") / CELL)
    cells = as_cells(members.join(large_sizes.select("cluster"), "cluster", "left_anti")).select("cell", "side", "uid", "items")
    for r in range(ROUNDS):  # cells that know nothing of one another go in one pass
        cells = cells.union(large.select(F.xxhash64("cluster", F.lit(r), F.pmod(F.xxhash64("uid", F.lit(r)), chunks)), F.lit(2), "uid", "items"))
    links = [link_cells(cells, percent, width, ranges)]
    # only members of large clusters need to be known as linked already
    labels = connected_components(links[0].join(large.select(F.col("uid").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
    labelled = large.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid"))
    labelled = materialise(labelled.select("cluster", "uid", "items", "size", "label"), "labelled")
    release(large, labels)
    counts = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    main = materialise(main.where("others > 0"), "main-components")
    rest = labelled.join(main, "cluster")
    row_chunks, col_chunks = F.ceil(F.col("others") / CELL).cast("int"), F.ceil(F.col("size") / CELL).cast("int")
    rows = (
        rest.where("label <> main").withColumn("i", F.pmod(F.xxhash64("uid", F.lit("i")), row_chunks).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), col_chunks - 1))).withColumn("side", F.lit(0))
    )
    cols = (
        rest.withColumn("j", F.pmod(F.xxhash64("uid", F.lit("j")), col_chunks).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), row_chunks - 1))).withColumn("side", F.lit(1))
    )
    wanted = [F.xxhash64("cluster", "i", "j").alias("cell"), "side", "uid", "items"]
    links.append(link_cells(rows.select(*wanted).union(cols.select(*wanted)), percent, width, ranges))
    release(labelled, main, large_sizes)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    out = materialise(out, "links")
    release(*links)
    return out
