"""Approximate nearest neighbours (operator 10): NN-descent and greedy graph search.

The graph has an edge from every vector to its ``DEGREE`` nearest known
neighbours.  It starts from cells of bounded size (one set of random cells, which
keeps the graph connected, and some sets of cells of vectors on the same side of
random hyperplanes) and improves by NN-descent: a vector's neighbours and reverse
neighbours meet in a cell and each learns its nearest among the others.  Cells
that a common vector or a hub would make too large are split at random; no
neighbour is dropped.

A query starts at its own vertex and walks the graph: in every round the
unvisited vertices among its ``BEAM`` nearest so far show their neighbours, until
none is left.  Distances of the result are computed in double precision from the
original vectors.

Vertices are distinct vectors, each under the smallest id that has it, so a group
of copies is one vertex and one walk.  What a walk finds is then opened into its
members: the first ``k`` + 1 ids of every vector, which is all that ``k`` nearest
can need, are cut out before rows are exchanged, so a group of any size is exact.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, neither as queries nor as candidates; rows without vec_id neither; rows
that share a vec_id count once, with the smallest vector; only vectors of the
same length are compared; with fewer candidates than asked for, all of them are
returned; equal distances go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.shared import materialise, release

DEGREE = 30
BEAM = 100
#: Vectors in a cell at the start, and in one where neighbours meet.
START_CELL, CELL = 4000, 800
#: Sets of cells by hyperplanes, and rounds of NN-descent.
TABLES, DESCENTS = 8, 2
#: Neighbours that a vector learns from a cell at the start, and where neighbours meet.
START_LEARNT, LEARNT = 12, 6
#: Nearest neighbours, and those that name a vector among theirs, that meet in its cell.
MEET = 16


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The vectors that take part: (id, vec as array<double>, dim), one row for each id."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("vec")).where("id is not null and vec is not null")
    return rows.where(fine & some).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each cell; rows (cell, id, vec) arrive with the rows of a cell in a row."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def cells(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell, ids, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.concatenate([[0], np.cumsum(size)])
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        stop = np.append(cut[1:], len(cell))
        done = len(cut) if last else len(cut) - 1
        for a, b in zip(cut[:done], stop[:done], strict=True):
            yield ids[a:b], flat[at[a] : at[b]].reshape(b - a, -1)  # a cell has vectors of one length
        a = cut[-1]
        held[:] = [] if last else [(cell[a:], ids[a:], size[a:], flat[at[a] :])]

    for batch in batches:
        if batch.num_rows:
            vec = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy()))
            yield from cells(False)
    if held:
        yield from cells(True)


def _meet(learn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["id", "near", "d2"])

        for ids, x in _groups(batches):
            m = len(ids)
            if m < 2:
                continue
            x = x.astype(np.float64)
            x = x - x.mean(0)
            norm = (x * x).sum(1)
            k = min(learn, m - 1)
            for low in range(0, m, 512):  # a block of rows at a time
                part = slice(low, low + 512)
                d2 = np.maximum(norm[part, None] + norm[None, :] - 2 * (x[part] @ x.T), 0)
                d2[ids[part, None] == ids[None, :]] = np.inf
                near = np.argpartition(d2, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(d2, near, axis=1)
                real = np.isfinite(best)
                out.append((np.repeat(ids[part], k)[real.ravel()], ids[near][real], best[real]))
            rows += m * k
            if rows > 100_000:
                yield flush()
                rows = 0
        if out:
            yield flush()

    return run


def _cells(rows: DataFrame, learn: int) -> DataFrame:
    """Distances that rows (cell, id, vec) learn from each other: (id, near, d2)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("cell", "id", "vec").repartition(max(parts, 16), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_meet(learn), "id bigint, near bigint, d2 double")


def _nearest(known: DataFrame, degree: int) -> DataFrame:
    best = known.groupBy("id", "near").agg(F.min("d2").alias("d2"))
    order = Window.partitionBy("id").orderBy("d2", "near")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).select("id", "near", "d2")


def _start(vectors: DataFrame, tables: int) -> DataFrame:
    """Cells of bounded size to start from: one random set, the others by sides of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(vectors.count(), 1) / START_CELL))))
    # planes go through the mean of the vectors of a length and follow from the length alone
    means = vectors.select("dim", F.posexplode("vec").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("a"))
    means = means.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("mean"))
    centred = vectors.join(means, "dim").select("id", F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m).alias("vec"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vec = batch.column(1)
            out = np.zeros((len(ids), tables), dtype=np.int64)
            sizes = np.diff(vec.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = vec.flatten().to_numpy()
            for d in np.unique(sizes).tolist() if bits else []:
                some = np.flatnonzero(sizes == d)
                planes = np.random.default_rng([3, d]).normal(size=(tables, bits, d))
                x = np.stack([flat[starts[i] : starts[i] + d] for i in some])
                for t in range(tables):
                    out[some, t] = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.int64()))], names=["id", "codes"])

    coded = centred.mapInArrow(codes, "id bigint, codes array<bigint>")
    keys = coded.select("id", F.posexplode("codes").alias("table", "code")).union(vectors.select("id", F.lit(-1), F.lit(0).cast("bigint")))
    keys = keys.join(vectors.select("id", "dim"), "id")
    sizes = keys.groupBy("dim", "table", "code").agg(F.count(F.lit(1)).alias("size"))
    keys = keys.join(sizes, ["dim", "table", "code"])
    chunk = F.pmod(F.xxhash64("id", "table"), F.ceil(F.col("size") / START_CELL))
    return keys.select("id", F.xxhash64("dim", "table", "code", chunk).alias("cell")).join(vectors.select("id", F.col("vec")), "id")


def build_graph(vectors: DataFrame, degree: int = DEGREE, descents: int = DESCENTS, tables: int = TABLES) -> DataFrame:
    """Neighbour graph of usable vectors (id, vec, dim): rows (id, near, d2)."""
    single = materialise(vectors.select("id", "dim", F.transform("vec", lambda x: x.cast("float")).alias("vec")), "vectors-single")
    graph = materialise(_nearest(_cells(_start(single, tables), START_LEARNT), degree), "graph")  # a vertex alone in its length has no edge
    for r in range(descents):
        close = graph.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d2", "near"))).where(F.col("r") <= MEET)
        both = close.select(F.col("id").alias("centre"), F.col("near").alias("id")).union(close.select(F.col("near"), F.col("id"))).distinct()
        both = both.union(single.select("id", "id"))
        sizes = both.groupBy("centre").agg(F.count(F.lit(1)).alias("size"))
        chunk = F.pmod(F.xxhash64("id", F.lit(r)), F.ceil(F.col("size") / CELL))
        rows = both.join(sizes, "centre").select("id", F.xxhash64("centre", chunk).alias("cell")).join(single.select("id", "vec"), "id")
        better = materialise(_nearest(graph.union(_cells(rows, LEARNT)), degree), "graph")
        release(graph)
        graph = better
    release(single)
    return graph


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def members(vectors: DataFrame, k: int) -> DataFrame:
    """The first ``k`` + 1 ids of every distinct vector: (vertex, id, vec, dim), the vertex being the smallest of them."""
    same = Window.partitionBy("vec").orderBy("id")
    first = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    return first.withColumn("vertex", F.min("id").over(Window.partitionBy("vec"))).select("vertex", "id", "vec", "dim")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
    """The ``k`` nearest vectors found for every query, an id of ``vectors`` (id, vec, dim): (query_id, rank, vec_id, score)."""
    first = materialise(members(vectors, k), "members")
    vertices = materialise(first.where("id = vertex").select("id", "vec", "dim"), "vertices")
    asked = queries.join(vectors.select(F.col("id").alias("query_id"), "vec"), "query_id")
    asked = materialise(asked.join(vertices.select(F.col("id").alias("vertex"), "vec"), "vec").select("query_id", "vertex"), "asked")
    graph = build_graph(vertices)
    found = search(graph, vertices, asked.select(F.col("vertex").alias("query_id")).distinct(), k, beam or BEAM)
    near = found.select(F.col("query_id").alias("start"), F.col("vec_id").alias("vertex"), "score")
    own = asked.select(F.col("vertex").alias("start"), "vertex", F.lit(0.0).alias("score")).distinct()
    opened = near.union(own).join(first.select("vertex", "id"), "vertex")
    # a walk's first k + 1 members hold the k nearest of every query of its vertex, whichever of them it is
    best = Window.partitionBy("start").orderBy("score", "id")
    opened = materialise(opened.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("start", "id", "score"), "opened")
    release(graph, first, vertices)
    each = asked.join(opened, asked["vertex"] == opened["start"]).where("query_id <> id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    out = materialise(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "nearest")
    release(asked, opened)
    return out


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest vertices that greedy search finds from every query's own vertex: (query_id, rank, vec_id, score).

    ``queries`` has query_id, an id of ``vectors``.
    """
    start = queries.join(vectors.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    start = materialise(start.select("query_id", "q"), "queries")
    # vertices known to a query, with their distance; the query's own vertex is at -1 so that it stays in the beam
    known = materialise(start.select("query_id", F.col("query_id").alias("id"), F.lit(-1.0).alias("score"), F.lit(False).alias("open")), "known")
    frontier = known.select("query_id", "id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    while True:
        seen = frontier.join(graph.select("id", "near"), "id").select("query_id", F.col("near").alias("id")).distinct()
        fresh = seen.join(known.select("query_id", "id"), ["query_id", "id"], "left_anti")
        measured = fresh.join(start, "query_id").join(vectors.select("id", "vec"), "id")
        measured = measured.select("query_id", "id", distance(F.col("q"), F.col("vec")).alias("score"), F.lit(True).alias("open"))
        # expanded vertices stay known; of the new ones those outside the beam can never enter it again
        both = known.select("query_id", "id", "score", F.lit(False).alias("open")).union(measured)
        following = materialise(both.withColumn("r", F.row_number().over(order)).where((F.col("r") <= beam + 1) | ~F.col("open")).drop("r"), "known")
        release(known)
        known = following
        frontier = known.where("open").select("query_id", "id")
        if not frontier.limit(1).count():
            break
    ranked = known.where("score >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "found")
    release(known, start)
    return out


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"))
    out = nearest(vectors, queries, 10)
    release(vectors)
    return out
