"""Nearest-neighbour, kernel and density statistics of two samples.

These need all pairs of rows.  Rows are packed into blocks of a fixed number of
vectors; a pair of blocks is one unit of work in which numpy computes the
distances and reduces them at once (a few numbers for each row, or sums).  The
matrix is never stored, no side is broadcast, and a unit's memory is bounded;
the cost is that of the statistic's own definition, one distance per pair: time
grows with n^2, the bytes that move with n times the side of the grid of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import EPSILON
from trialspark.operators.ranging import exact_quantiles, with_ordinal, with_running_totals
from trialspark.storage import materialise, release

#: Vectors in a block.
BLOCK = 1024


def pack(x: np.ndarray) -> bytes:
    """Vectors one after the other, in single precision if that holds them exactly."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"f" + short.tobytes() if np.array_equal(short, x) else b"d" + x.astype("<f8").tobytes()


def unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"f" else "<f8", offset=1).astype(float).reshape(rows, (len(data) - 1) // (4 if data[:1] == b"f" else 8) // rows)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as a matrix; a missing component is NaN."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), lengths[0] if len(lengths) else 0)


def blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """Rows packed into blocks, written: (block, ids, x) with x the packed vectors."""
    n = df.count()
    parts = max(1, -(-n // size))

    def packed(table: pa.Table) -> pa.Table:
        ids = table.column(1).combine_chunks()
        return pa.table({"block": table.column(0).slice(0, 1), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "x": pa.array([pack(vectors(table.column(2)))], pa.binary())})

    rows = df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("bigint").alias("block"), F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return materialise(rows.groupBy("block").applyInArrow(packed, "block bigint, ids array<bigint>, x binary"), "blocks")


#: Blocks on a side of a grid cell, which one task holds.
SIDE = 16


def block_cells(left: DataFrame, right: DataFrame, reduce_cell: Callable, schema: str, extra: str | None = None, half: bool = False) -> DataFrame:
    """Apply ``reduce_cell(left blocks, right blocks, same)`` to the cells of a grid of pairs of blocks.

    A block is (ids, vectors, r), with r the values of ``extra``, a column of right
    blocks holding a number for each row.  It yields dictionaries of columns.  Each
    block is dealt to one row or column of the grid, so what moves is the blocks times
    the grid's side, not the pairs, and a task holds ``SIDE`` blocks of each side.
    With ``half`` both sides are one table and every two of its parts meet in one cell
    only; ``same`` says that the cell's sides are the same part.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (2 if half else 1)
    counts = left.agg(F.count(F.lit(1))).first()[0], right.agg(F.count(F.lit(1))).first()[0]
    rows, cols = (max(1, -(-n // SIDE), min(n, ceil(sqrt(tasks)))) for n in counts)
    kinds = {f.split()[0]: _ARROW[f.split(maxsplit=1)[1]] for f in schema.split(", ")}
    names = pa.schema(list(kinds.items()))
    value = F.lit(None).cast("array<double>")
    line = lambda low, high: F.explode(F.sequence(low, high))
    i, j = (F.pmod("block", F.lit(n)).cast("int") for n in (rows, cols))
    a = left.select(i.alias("i"), line(i if half else F.lit(0), F.lit(cols - 1)).alias("j"), F.lit(0).alias("side"), "ids", "x", value.alias("r"))
    b = right.select(line(F.lit(0), j if half else F.lit(rows - 1)).alias("i"), j.alias("j"), F.lit(1).alias("side"), "ids", "x", (F.col(extra) if extra else value).alias("r"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, same = ([], []), False
        for batch in batches:
            for i, j, side, ids, x, r in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                sides[side].append((np.array(ids), unpack(x, len(ids)), np.array(r, dtype=float) if extra else None))
                same = half and i == j
        if sides[0] and sides[1]:
            for out in reduce_cell(*sides, same):
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], schema=names)

    fields = ["i", "j", "side", "ids", "x", "r"]
    return a.select(*fields).unionByName(b.select(*fields)).groupBy("i", "j").applyInArrow(cells, schema)


def block_pairs(left: DataFrame, right: DataFrame, reduce_pair: Callable, schema: str) -> DataFrame:
    """Apply ``reduce_pair(left ids, left vectors, right ids, right vectors)``, which yields dictionaries of columns, to every pair of blocks."""

    def cell(lefts, rights, same):
        for ids, x, _ in lefts:
            for ids2, x2, _ in rights:
                yield from reduce_pair(ids, x, ids2, x2)

    return block_cells(left, right, cell, schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

#: Distances whose square is a smaller share than this of the squared lengths are taken from differences.
CLOSE = 2.0**-7
_EPS = float(np.finfo(float).eps)


def exact_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of ``a`` and j of ``b``, from differences: equal for equal rows, wherever they stand."""
    out = np.empty(len(i))
    step = max(1, (1 << 18) // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        d = a[i[k : k + step]] - b[j[k : k + step]]
        out[k : k + step] = (d * d).sum(1)
    return out


def quick_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared distances by a matrix product, lengths of the rows of ``a`` and the greatest of ``b``'s, all squared and from the middle of ``b``.

    An error is at most ``slack`` of the two lengths.  Where the product is not finite
    all distances are exact and the lengths zero.
    """
    middle = b.mean(0)
    with np.errstate(all="ignore"):
        p, q = a - middle, b - middle
        x, y = (p * p).sum(1), (q * q).sum(1)
        if not np.isfinite(4 * (x.max() + y.max())):
            i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
            return exact_pairs(a, b, i, j).reshape(len(a), len(b)), np.zeros(len(a)), 0.0
    return _extended(p, x) @ _extended(q, y, True).T, x, float(y.max())


def _extended(p: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """Rows with their squared lengths, so that products of left and right ones are squared distances."""
    one = np.ones((len(p), 1))
    return np.concatenate([p, one, x[:, None]] if right else [p * -2, x[:, None], one], axis=1)


def slack(a: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
    """Bound of the error of ``quick_squares`` for every row."""
    return (6 * a.shape[1] + 32) * _EPS * (x + y)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows: from one matrix product, and small ones from differences, so that equal rows are at 0."""
    d, x, y = quick_squares(a, b)
    if not d.min() >= CLOSE * (x.max() + y):
        i, j = np.nonzero(d < CLOSE * (x[:, None] + y))
        d[i, j] = near_pairs(a, b, i, j)
    return d


def near_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_pairs``; where they are many, equal rows need no difference."""
    if len(i) <= 8 * (len(a) + len(b)):
        return exact_pairs(a, b, i, j)
    codes: dict[bytes, int] = {}
    left, right = (np.array([codes.setdefault(row.tobytes(), len(codes)) for row in m]) for m in (a, b))
    out, apart = np.zeros(len(i)), left[i] != right[j]
    finite = np.isfinite(a).all(1)
    apart |= ~finite[i]
    out[apart] = exact_pairs(a, b, i[apart], j[apart])
    return out


class Single:
    """Rows that others are measured from in single precision, with a bound of the error of their squared distances."""

    def __init__(self, b: np.ndarray):
        self.b = b
        with np.errstate(all="ignore"):
            self.middle = b.mean(0)
            q = b - self.middle
            y = (q * q).sum(1)
            self.most, self.rows = float(y.max()), _extended(q, y, True).astype("f4")

    def tiles(self, a: np.ndarray, first: int = 0) -> Iterator[tuple]:
        """(rows of a, of b, squared distances, bound of their error) of all rows of ``a`` with those of ``b`` from ``first`` on; without a finite product there are no distances."""
        for k in range(0, len(a), _ROWS):
            part = a[k : k + _ROWS]
            with np.errstate(all="ignore"):
                p = part - self.middle
                x = (p * p).sum(1)
                left, size = _extended(p, x).astype("f4"), float(x.max()) + self.most
            known = size < float(np.finfo("f4").max) / 8
            for low in range(first, len(self.b), BLOCK):
                d = left @ self.rows[low : low + BLOCK].T if known else None
                yield part, self.b[low : low + BLOCK], d, (2 * a.shape[1] + 16) * 2.0**-23 * size + 1e-36


def distances(a: np.ndarray, b: np.ndarray, norm: str = "l2") -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``; equal rows are at 0."""
    if norm != "l1":
        return np.sqrt(squares(a, b))
    out = np.zeros((len(a), len(b)))
    columns, step = np.ascontiguousarray(b.T), max(1, (1 << 14) // max(1, len(b)))
    buffer = np.empty((step, len(b)))
    for i in range(0, len(a), step):
        part = out[i : i + step]
        each = buffer[: len(part)]
        for k, column in enumerate(columns):
            np.subtract(a[i : i + step, k, None], column[None, :], out=each)
            np.abs(each, out=each)
            part += each
    return out


def k_smallest(left: DataFrame, right: DataFrame, k: int, same: bool) -> DataFrame:
    """L3: the ``k`` smallest distances of every left row to right rows: (id, d array), ascending.

    ``same``: both sides are one table, and a row is no neighbour of itself.  A matrix
    product leaves out what is surely too far; the rest is measured from differences.
    """

    def cell(lefts, rights, _):
        whole, ids2 = Single(np.concatenate([b[1] for b in rights])), np.concatenate([b[0] for b in rights])
        for ids, a in _slices(lefts):
            row, near, bound = np.empty(0, dtype=np.int64), np.empty(0), np.full(len(ids), np.inf)
            own = same and np.isin(ids, ids2).any()
            for at, b, d, off in _bounded_tiles(whole, a):
                if own:
                    d[ids[:, None] == ids2[None, at]] = np.inf
                reach = bound + off
                if not np.isfinite(reach).all():
                    m = min(k, d.shape[1])
                    reach = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1] + 2 * off, reach)
                i, j = _places(d <= _above(np.minimum(reach, _MOST), d)[:, None])
                if not len(i):
                    continue
                row, near = np.concatenate([row, i]), np.concatenate([near, exact_pairs(a, b, i, j)])
                row, near = _smallest(row, near, k)
                full = np.flatnonzero(np.bincount(row, minlength=len(ids)) >= k)
                bound[full] = near[np.searchsorted(row, full, side="right") - 1]
            lists = np.split(np.sqrt(near), np.searchsorted(row, np.arange(1, len(ids))))
            yield {"id": ids, "d": lists}

    parts = block_cells(left, right, cell, "id bigint, d array<double>")
    return parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))


#: Rows of the left side that are compared at once, so that their distances stay in a core's cache.
_ROWS = 256
_MOST = float(np.finfo(float).max)


def _slices(blocks: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, x, _ in blocks:
        for k in range(0, len(ids), _ROWS):
            yield ids[k : k + _ROWS], x[k : k + _ROWS]


def _bounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product and the bound of their error for every row; infinite where there is none."""
    d, x, y = quick_squares(a, b)
    if not y:  # else the product is finite
        d[np.isnan(d)] = np.inf
    return d, slack(a, x, y)


def _bounded_tiles(whole: Single, a: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(place among the other rows, these rows, ``_bounded`` of ``a`` and them), in single precision where that is finite; ``a`` has at most ``_ROWS`` rows."""
    low = 0
    for _, b, d, off in whole.tiles(a):
        d, off = _bounded(a, b) if d is None else (d, np.full(len(a), off))
        yield slice(low, low + len(b)), b, d, off
        low += len(b)


def _above(limits: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Limits in the precision of ``d``, not smaller; finite ones stay finite."""
    if d.dtype != np.float32:
        return limits
    most = np.finfo("f4").max
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(limits), np.nextafter(np.clip(limits, -most, most).astype("f4"), most), limits).astype("f4")


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where a matrix is true; quick where few are."""
    flat = np.ascontiguousarray(mask).ravel()
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), mask.shape[1])
    words = np.flatnonzero(flat.view(np.uint64))  # eight at a time
    k = np.flatnonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[k >> 3] * 8 + (k & 7), mask.shape[1])


def _smallest(row: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest finite values of every row, by row and value."""
    finite = np.isfinite(value)
    row, value = row[finite], value[finite]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], value[first]


def pairwise(left: DataFrame, right: DataFrame, norm: str = "l2") -> DataFrame:
    """All distances, (id, id2, d); the result has a row for each pair by definition."""

    def pair(ids, a, ids2, b):
        yield {"id": np.repeat(ids, len(ids2)), "id2": np.tile(ids2, len(ids)), "d": distances(a, b, norm).ravel()}

    return block_pairs(left, right, pair, "id bigint, id2 bigint, d double")


def kernel_matrix(left: DataFrame, right: DataFrame, function: Callable[[np.ndarray], np.ndarray], norm: str = "l2") -> DataFrame:
    """Values of any kernel given as a function of arrays of distances: (id, id2, k)."""

    def pair(ids, a, ids2, b):
        yield {"id": np.repeat(ids, len(ids2)), "id2": np.tile(ids2, len(ids)), "k": np.asarray(function(distances(a, b, norm)), dtype=float).ravel()}

    return block_pairs(left, right, pair, "id bigint, id2 bigint, k double")


def _with_radii(centres: DataFrame, radii: DataFrame) -> DataFrame:
    """Blocks with the radius of every row: (block, ids, x, r)."""
    each = centres.select("block", F.posexplode("ids").alias("i", "id")).join(radii, "id")
    lists = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias("r"))
    return centres.join(lists, "block")


def within_radii(points: DataFrame, centres: DataFrame, radii: DataFrame, closed: bool) -> DataFrame:
    """For every point, how many balls of the centres' radii hold it, and its least distance: (id, inside, nearest).

    A point that a matrix product places close to a ball's edge is measured from
    differences, as the radii are, so that ties come out alike.
    """

    def cell(lefts, rights, _):
        whole, r = Single(np.concatenate([b[1] for b in rights])), np.concatenate([b[2] for b in rights])
        for ids, a in _slices(lefts):
            inside, nearest = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), np.inf)
            for at, b, d, off in _bounded_tiles(whole, a):
                least = d.min(1)
                reach = np.minimum(np.minimum(least, nearest) + 2 * off, _MOST)
                some = np.flatnonzero(least <= reach)
                if len(some):
                    i, j = _places(d[some] <= _above(reach[some], d)[:, None])
                    np.minimum.at(nearest, some[i], exact_pairs(a, b, some[i], j))
                ball = r[at]
                edge = off.max() + 8 * _EPS * ball * ball
                i, j = _places(d <= _above(ball * ball + edge, d)[None, :])
                if len(i):
                    surely = d[i, j] < -_above(edge - ball * ball, d)[j]
                    inside += np.bincount(i[surely], minlength=len(ids))
                    i, j = i[~surely], j[~surely]
                    far = np.sqrt(exact_pairs(a, b, i, j))
                    inside += np.bincount(i[far <= ball[j] if closed else far < ball[j]], minlength=len(ids))
            yield {"id": ids, "inside": inside, "nearest": np.sqrt(nearest)}

    parts = block_cells(points, _with_radii(centres, radii), cell, "id bigint, inside bigint, nearest double", "r")
    return parts.groupBy("id").agg(F.sum("inside").alias("inside"), F.min("nearest").alias("nearest"))


def _radius(table: DataFrame, k: int) -> DataFrame:
    """Distance of every row to its ``k``-th neighbour, (id, r), written: more than one job reads it."""
    return materialise(k_smallest(table, table, k, True).select("id", F.element_at("d", -1).alias("r")), "radii")


def precision_recall(real: DataFrame, synth: DataFrame, k: int = 3) -> DataFrame:
    """M1: share of synthetic rows within a real row's k-neighbour ball, and the reverse; balls are closed."""
    precision = within_radii(synth, real, _radius(real, k), True).agg(F.avg((F.col("inside") > 0).cast("double")).alias("precision"))
    recall = within_radii(real, synth, _radius(synth, k), True).agg(F.avg((F.col("inside") > 0).cast("double")).alias("recall"))
    return precision.crossJoin(recall)


def prdc(real: DataFrame, synth: DataFrame, k: int = 5) -> DataFrame:
    """M2: precision, recall, density and coverage; balls are open."""
    radii = _radius(real, k)
    by_synth = within_radii(synth, real, radii, False).agg(
        F.round(F.avg((F.col("inside") > 0).cast("double")), 6).alias("precision"), F.round(F.avg(F.col("inside") / k), 6).alias("density")
    )
    by_real = within_radii(real, synth, _radius(synth, k), False)
    recall = by_real.agg(F.round(F.avg((F.col("inside") > 0).cast("double")), 6).alias("recall"))
    coverage = by_real.join(radii, "id").agg(F.round(F.avg((F.col("nearest") < F.col("r")).cast("double")), 6).alias("coverage"))
    return by_synth.crossJoin(recall).crossJoin(coverage).select("precision", "recall", "density", "coverage")


def kernel_sums(left: DataFrame, right: DataFrame, gamma: float) -> DataFrame:
    """Sum of exp(-gamma d^2) over all pairs, and over the pairs of rows that are one: (total, own, n)."""

    def pair(ids, a, ids2, b):
        k = np.exp(-gamma * squares(a, b))
        yield {"total": [float(k.sum())], "own": [float(k[ids[:, None] == ids2[None, :]].sum())], "n": [k.size]}

    return block_pairs(left, right, pair, "total double, own double, n bigint").agg(F.sum("total").alias("total"), F.sum("own").alias("own"), F.sum("n").alias("n"))


def mmd(real: DataFrame, synth: DataFrame, gamma: float = 1.0, paired: DataFrame | None = None) -> DataFrame:
    """M6, M7: biased and unbiased squared MMD under exp(-gamma d^2): (biased, unbiased).

    With samples of equal size the unbiased one leaves out the pairs of rows at the
    same place; ``paired`` has these pairs' squared distances as d2.
    """
    x, y, xy = (kernel_sums(a, b, gamma).toDF(f"t{s}", f"o{s}", f"n{s}") for s, a, b in (("x", real, real), ("y", synth, synth), ("c", real, synth)))
    out = lambda s: (F.col(f"t{s}") - F.col(f"o{s}")) / (F.col(f"n{s}") - F.sqrt(F.col(f"n{s}").cast("double")))
    cross = F.col("tc") / F.col("nc")
    both = x.crossJoin(y).crossJoin(xy)  # a row each
    if paired is None:
        unbiased = out("x") + out("y") - 2 * cross
    else:
        both = both.crossJoin(paired.agg(F.sum(F.exp(-F.lit(float(gamma)) * F.col("d2"))).alias("same")))
        unbiased = out("x") + out("y") - 2 * (F.col("tc") - F.col("same")) / (F.col("nc") - F.sqrt(F.col("nc").cast("double")))
    return both.select((F.col("tx") / F.col("nx") + F.col("ty") / F.col("ny") - 2 * cross).alias("biased"), unbiased.alias("unbiased"))


def paired_distances(real: DataFrame, synth: DataFrame, key: str, vector: str) -> DataFrame | None:
    """Squared distances of rows at the same place in the order of a key: (d2); None for tables of different size."""
    if real.count() != synth.count():
        return None
    a, b = (with_ordinal(d.select(key, F.col(vector).alias(n)), [key]).select("_row", n) for d, n in ((real, "a"), (synth, "b")))
    return a.join(b, "_row").select(F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v).alias("d2"))


def entropy_weights(df: DataFrame, vector: str) -> DataFrame:
    """Weight of every component, the inverse of the entropy of its values: (i, w); a constant component's entropy counts as the machine epsilon."""
    counts = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("i").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("s"))
    entropy = F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t")
    return totals.select("i", (1 / F.when(entropy > EPSILON, entropy).otherwise(F.lit(EPSILON))).alias("w"))


def weighted(df: DataFrame, vector: str, weights: dict[int, float]) -> DataFrame:
    """Vectors with every component times its weight."""
    by_place = F.array(*[F.lit(weights[i]) for i in sorted(weights)])
    return df.withColumn(vector, F.zip_with(F.transform(vector, lambda v: v.cast("double")), by_place, lambda v, w: v * w))


def identifiability(real: DataFrame, synth: DataFrame, vector: str) -> DataFrame:
    """Share of real rows whose nearest synthetic row is closer than their nearest other real row, on ``weighted`` vectors.

    Distinct vectors are counted on both sides: one that several real rows share has
    another real row at no distance, and one that a synthetic row shares that one.
    The rest search in boxes (``_nearest_in_boxes``) or, beyond ``BOX_DIMENSIONS``,
    over all pairs.  Vectors with a component that is missing or not finite take no
    part; the score is null without a second real row or without a synthetic one.
    """
    count = lambda df, r, s: df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda v: v.cast("double")).alias("v"), F.lit(r).alias("r"), F.lit(s).alias("s"))
    both = count(real, 1, 0).unionByName(count(synth, 0, 1)).where(F.forall("v", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    rows = materialise(both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("s").alias("s")).withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    shared = F.when((F.col("r") == 1) & (F.col("s") > 0), 1).otherwise(0)
    n, m, alone, known, dimensions = rows.agg(F.sum("r"), F.sum("s"), F.count(F.when((F.col("r") == 1) & (F.col("s") == 0), 1)), F.sum(shared), F.max(F.size("v"))).first()
    hits = 0
    if alone and n > 1 and m:
        if dimensions <= BOX_DIMENSIONS:
            near = _nearest_in_boxes(rows)
        else:
            mine, theirs, lone = (blocks(rows.where(c), "id", "v") for c in ("r > 0", "s > 0", "r = 1 and s = 0"))
            other = k_smallest(lone, mine, 1, True).select("id", F.get("d", 0).alias("other"))
            near = other.join(k_smallest(lone, theirs, 1, False).select("id", F.get("d", 0).alias("close")), "id")
        hits = near.agg(F.count(F.when(F.col("close") < F.col("other"), 1))).first()[0]
    release(rows)
    score = (hits + known) / n if n and n > 1 and m else None
    return real.sparkSession.createDataFrame([(score,)], "score double")


#: Most components of vectors that are searched in boxes.
BOX_DIMENSIONS = 8
#: Vectors in a box, and vectors that the boxes are cut by.
BOX, BOX_SAMPLE = 512, 200_000


def _box_tree(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Halves vectors along their widest component: (component, cut, node below the cut, node from it on), or (-1, 0, leaf, 0)."""
    nodes, leaf, todo = [(-1, 0.0, 0, 0)], 0, [(0, x, leaves)]
    while todo:
        node, part, n = todo.pop()
        k = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
        cut = np.median(part[:, k]) if len(part) else 0.0
        if len(part) and not (part[:, k] < cut).any():
            above = part[:, k][part[:, k] > cut]
            cut = above.min() if len(above) else cut
        low = part[:, k] < cut
        if n <= 1 or not low.any():
            nodes[node], leaf = (-1, 0.0, leaf, 0), leaf + 1
            continue
        nodes[node] = (k, float(cut), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), part[low], n // 2), (len(nodes) + 1, part[~low], n - n // 2)]
        nodes += [(-1, 0.0, 0, 0)] * 2
    return nodes


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, component after component."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def _nearest_in_boxes(rows: DataFrame) -> DataFrame:
    """Distances from vectors of one real and no synthetic row to the nearest other real and the nearest synthetic vector: (id, other, close).

    ``rows`` has distinct vectors (id, v, r, s), r real and s synthetic rows each.  They
    are cut into boxes by the halves of a sample, every vector in one.  A vector is
    compared with its own box and with those that lie no farther than what it found
    there, so the result is exact; the driver holds the corners of the boxes.
    """
    n = rows.count()
    sample = vectors(rows.sample(min(1.0, BOX_SAMPLE / n), seed=0).select("v").limit(2 * BOX_SAMPLE).toArrow().column("v")) if n > BOX else np.empty((0, 1))
    tree = _box_tree(sample, -(-n // BOX))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, cut, low, high = (np.array(c) for c in zip(*tree, strict=True))
        for batch in batches:
            if batch.num_rows:
                x, node = vectors(pa.chunked_array([batch.column(1)])), np.zeros(batch.num_rows, dtype=np.int64)
                while len(at := np.flatnonzero(kind[node] >= 0)):
                    here = node[at]
                    node[at] = np.where(x[at, kind[here]] < cut[here], low[here], high[here])
                yield pa.RecordBatch.from_arrays([pa.array(low[node]), *batch.columns], names=["block", "id", "v", "r", "s"])

    def packed(table: pa.Table) -> pa.Table:
        x = vectors(table.column("v"))
        r, s = (table.column(c).to_numpy() for c in ("r", "s"))
        out = {"block": table.column("block").slice(0, 1), "ids": [table.column("id").to_pylist()], "x": [pack(x)], "r": [r.tolist()], "s": [s.tolist()]}
        return pa.table(out | {"low": [x.min(0).tolist()], "high": [x.max(0).tolist()], "some_r": [bool((r > 0).any())], "some_s": [bool((s > 0).any())]})

    placed = rows.select("id", "v", "r", "s").mapInArrow(place, "block bigint, id bigint, v array<double>, r bigint, s bigint")
    boxes = materialise(placed.groupBy("block").applyInArrow(packed, "block bigint, ids array<bigint>, x binary, r array<bigint>, s array<bigint>, low array<double>, high array<double>, some_r boolean, some_s boolean"), "boxes")
    corners = boxes.select("block", "low", "high", "some_r", "some_s").orderBy("block").collect()  # a row for each box
    number = np.array([c["block"] for c in corners])
    low, high = (np.array([c[k] for c in corners]) for k in ("low", "high"))
    some = [np.array([c[k] for c in corners]) for k in ("some_r", "some_s")]
    names = ["block", "ids", "x", "other", "close"]

    def unit(block, ids, x, near):
        columns = [[int(block)], [ids.tolist()], [pack(x)], [near[0].tolist()], [near[1].tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for box in batch.to_pylist():
                ids, r, s = (np.array(box[c]) for c in ("ids", "r", "s"))
                x = unpack(box["x"], len(ids))
                alone = np.flatnonzero((r == 1) & (s == 0))
                if not len(alone):
                    continue
                q, here = x[alone], int(np.searchsorted(number, box["block"]))
                d = _differences(q, x)
                d[np.arange(len(alone)), alone] = np.inf
                near = [d[:, c > 0].min(1, initial=np.inf) for c in (r, s)]
                yield unit(-1, ids[alone], q, near)
                need = {}
                gap = np.maximum(np.maximum(low - high[here], low[here] - high), 0)
                gap = (gap * gap).sum(1)
                for found, there in zip(near, some, strict=True):
                    there = there & (np.arange(len(number)) != here)
                    reach = found
                    if not np.isfinite(found).all() and there.any():  # the farthest corner of a box bounds the distance to what it holds
                        far = np.maximum(high[there] - low[here], high[here] - low[there])
                        reach = np.minimum(found, (far * far).sum(1).min())
                    reach = reach * (1 + 1e-9)
                    for b in np.flatnonzero(there & (gap <= reach.max())):
                        out = np.maximum(np.maximum(low[b] - q, q - high[b]), 0)
                        need[b] = need.get(b, False) | ((out * out).sum(1) <= reach)
                for b, which in need.items():
                    if which.any():
                        yield unit(number[b], ids[alone][which], q[which], [f[which] for f in near])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"])
                near = [np.array(row[c]) for c in ("other", "close")]
                if row["y"] is not None:
                    d = _differences(unpack(row["x"], len(ids)), unpack(row["y"], len(row["r"])))
                    near = [np.minimum(f, d[:, np.array(row[c]) > 0].min(1, initial=np.inf)) for f, c in zip(near, ("r", "s"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.sqrt(f)) for f in near)], names=["id", "other", "close"])

    units = materialise(boxes.select("block", "ids", "x", "r", "s").mapInArrow(own, "block bigint, ids array<bigint>, x binary, other array<double>, close array<double>"), "box-units")
    meets = units.join(boxes.select("block", F.col("x").alias("y"), "r", "s"), "block", "left").select("ids", "x", "other", "close", "y", "r", "s")
    out = materialise(meets.mapInArrow(compare, "id bigint, other double, close double").groupBy("id").agg(F.min("other").alias("other"), F.min("close").alias("close")), "box-nearest")
    release(boxes, units)
    return out


def kde_log_density(queries: DataFrame, reference: DataFrame, bandwidth: float, dimensions: int) -> DataFrame:
    """Log density of queries under a Gaussian kernel estimate: (id, log_density)."""

    def cell(lefts, rights, _):
        for ids, a in _slices(lefts):
            top, s = np.full(len(ids), -np.inf), np.zeros(len(ids))
            for _, b, _ in rights:
                e = squares(a, b)
                e /= -2 * bandwidth**2
                most = np.maximum(top, e.max(1))
                e -= most[:, None]
                s = s * np.exp(top - most) + np.exp(e, out=e).sum(1)
                top = most
            yield {"id": ids, "top": top, "s": s, "n": np.full(len(ids), sum(len(b) for b, _, _ in rights))}

    parts = block_cells(queries, reference, cell, "id bigint, top double, s double, n bigint")
    # a number for each column of the grid, in one pass over the pairs
    best = parts.groupBy("id").agg(F.max("top").alias("best"), F.sum("n").alias("total"), F.collect_list(F.struct("top", "s")).alias("each"))
    total = best.withColumn("s", F.aggregate("each", F.lit(0.0), lambda s, e: s + e["s"] * F.exp(e["top"] - F.col("best"))))
    constant = dimensions * (np.log(bandwidth) + 0.5 * np.log(2 * np.pi))
    return total.select("id", (F.col("best") + F.ln("s") - F.ln(F.col("total").cast("double")) - F.lit(float(constant))).alias("log_density"))


def auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, from running counts by score."""
    counts = scores.groupBy(F.col(score).alias("v")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    run = with_running_totals(counts, "v", ["q"])
    won = run.select((F.col("p") * (F.col("q_before") + F.col("q") / 2)).alias("won"), "p", "q")
    return won.agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def membership_inference(synth: DataFrame, members: DataFrame, others: DataFrame, reference: DataFrame, dimensions: int, bandwidth: float = 0.5, ratio: str = "log") -> DataFrame:
    """Attack scores of members and others, (id, member, score), from densities under the synthetic and the reference rows.

    ``ratio='log'`` divides log densities, as the reference does; ``'density'``
    takes their difference, the log of the ratio.
    """
    parts = []
    for label, table in ((1, members), (0, others)):
        g = kde_log_density(table, synth, bandwidth, dimensions).withColumnRenamed("log_density", "g")
        r = kde_log_density(table, reference, bandwidth, dimensions).withColumnRenamed("log_density", "r")
        score = F.col("g") / (F.col("r") + 1e-10) if ratio == "log" else F.col("g") - F.col("r")
        parts.append(g.join(r, "id").select("id", F.lit(label).alias("member"), score.alias("score")))
    return parts[0].unionByName(parts[1])


def attack_quality(scores: DataFrame) -> DataFrame:
    """(accuracy, auc) of attack scores (score, member): a row above the median score is called a member."""
    scores = materialise(scores.select("score", "member"), "scores")  # else every figure below measures all pairs again
    middle = exact_quantiles(scores, "score", [0.5])
    called = F.col("score") > F.lit(middle[0] if middle else None).cast("double")
    accuracy = scores.agg(F.avg((called == (F.col("member") == 1)).cast("double")).alias("accuracy"))
    return accuracy.crossJoin(auc(scores, "score", "member"))  # a row each


def normal_log_density(queries: DataFrame, fitted: DataFrame, key: str, vector: str) -> DataFrame:
    """Log density of queries under one normal distribution with the mean and covariance of ``fitted``: (id, log_density)."""
    from trialspark.operators.stats import _moments

    mean, cov = _moments(fitted, vector)
    root = np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(len(mean))))
    constant = float(np.log(np.diag(root)).sum() - 0.5 * len(mean) * np.log(2 * np.pi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = (np.array(batch.column(1).to_pylist(), dtype=float) - mean) @ root.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(constant - 0.5 * (z * z).sum(1))], names=["id", "log_density"])

    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return rows.mapInArrow(run, "id bigint, log_density double")
