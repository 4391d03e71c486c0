"""Resampling tests on kernel two-sample statistics (M8-M11, M13-M17), for samples of any size.

The statistic of every resample is a quadratic or linear form in the kernel
matrix.  Rows are packed into blocks that go to a grid of tasks; a pair of blocks
makes its part of the kernel matrix, multiplies it with the resamples' values of
its rows, and only the sums leave the task.  Neither rows nor the matrix nor the
resamples come to the driver: a row's values follow from the seed and its number,
and labels that are permuted from the seed, its block and how many of the block's
rows each resample puts into the first sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.ranging import exact_quantiles, with_ordinal
from trialspark.operators.resampled import aggregated, settled
from trialspark.operators.twosample import Single, block_cells, distances, near_pairs, pack, squares, vectors
from trialspark.storage import materialise, release

#: Rows in a block; with B resamples a task holds a few matrices of BLOCK by B.
BLOCK = 256
#: Values between two histogram edges that are collected to tell ranks exactly.
FINE = 1_000_000
_BINS = 1 << 16
#: Distances that tell where a rank may lie, and the share of all on either side of it that is looked at first.
GUESSES, _MARGIN = 1 << 20, 0.002
#: A part of the kernel matrix with a smaller share than one in so many that are not zero is multiplied without the rest.
_FEW = 16
#: Columns of a part of the kernel matrix that is multiplied at once; even.
_WIDE = 2048


def numbered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows numbered by their key: (_row, v)."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return with_ordinal(rows, ["_key"]).select("_row", "v")


def pooled(samples: list[DataFrame], key: str, vector: str, size: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """Blocks of several samples, (block, ids, x), written, and the samples' sizes.

    An id is the row's number times the number of samples plus that of its sample;
    rows of the same number are in one block.
    """
    n = len(samples)
    rows = [numbered(d, key, vector).select((F.col("_row") * n + k).alias("id"), "v") for k, d in enumerate(samples)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    every = materialise(every, "pooled")
    sizes = {r["k"]: r["n"] for r in every.groupBy((F.col("id") % n).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def packed(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        x = vectors(table.column("v"))[order]
        return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([table.column("id").to_numpy()[order].tolist()], pa.list_(pa.int64())), "x": pa.array([pack(x)], pa.binary())})

    cells = every.select(F.floor(F.col("id") / (n * max(1, size // n))).alias("block"), "id", "v").groupBy("block").applyInArrow(packed, "block bigint, ids array<bigint>, x binary")
    out = materialise(cells, "pooled-blocks")
    release(every)
    return out, [sizes.get(k, 0) for k in range(n)]


def kernel_of(name: str, d: np.ndarray) -> np.ndarray:
    """Kernel values at scaled distances."""
    if name == "gaussian":
        return np.exp(-d * d)
    if name == "imq":
        return 1 / np.sqrt(1 + d * d)
    if name == "laplace":
        return np.exp(-d)
    order = float(name.removeprefix("matern_").removesuffix("_l1").removesuffix("_l2"))
    r = d if order == 0.5 else np.sqrt(2 * order) * d
    terms = {0.5: (1.0,), 1.5: (1.0, 1.0), 2.5: (1.0, 1.0, 1 / 3), 3.5: (1.0, 1.0, 2 / 5, 1 / 15), 4.5: (1.0, 1.0, 3 / 7, 2 / 21, 1 / 105)}[order]
    return sum(c * r**k for k, c in enumerate(terms)) * np.exp(-r)


def _norm(name: str) -> str:
    return "l1" if name == "laplace" or name.endswith("_l1") else "l2"


# Collections of kernels by name.
_ORDERS = ("matern_0.5", "matern_1.5", "matern_2.5", "matern_3.5", "matern_4.5")
COLLECTIONS = {
    "laplace_gaussian": ("laplace", "gaussian"),
    "gaussian_laplace": ("laplace", "gaussian"),
    "all_matern_l1": tuple(f"{k}_l1" for k in _ORDERS),
    "all_matern_l2": tuple(f"{k}_l2" for k in _ORDERS),
    "all_matern_l1_l2": tuple(f"{k}_{n}" for n in ("l1", "l2") for k in _ORDERS),
    "all": (*(f"{k}_{n}" for n in ("l1", "l2") for k in _ORDERS), "gaussian", "imq"),
}


class Distances:
    """Order statistics of the distances between rows of blocks, whatever their number: of every two rows, or of those that a predicate on their ids admits.

    Euclidean distances are first taken in single precision, as squares with a bound
    of their error; those that it leaves open are measured from differences.
    """

    def __init__(self, blocks: DataFrame, admit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, norm: str = "l2"):
        self.blocks, self.admit, self.norm = blocks, admit, norm
        self.known: tuple | None = None
        self.guesses = np.empty(0)

    def _tiled(self, reduce_tiles: Callable[[Iterator[tuple]], dict]) -> Callable:
        """For a cell of the grid, ``reduce_tiles`` of (rows, rows, squared distances, bound of their error, None), or of (rows, rows, None, 0, the pairs meant)."""
        admit = self.admit

        def strips(rights: Single, a, first=0):
            for x, y, d, off in rights.tiles(a, first):
                yield (x, y, d, off, None) if d is not None else (x, y, None, 0.0, np.divmod(np.arange(len(x) * len(y)), len(y)))

        def tiles(lefts, rights, same):
            if admit is None:
                rights = sorted(rights, key=lambda b: b[0][0])
                starts, firsts = np.cumsum([0] + [len(b[0]) for b in rights]), [b[0][0] for b in rights]
                whole = Single(np.concatenate([b[1] for b in rights]))
                for ids, x, _ in lefts:
                    if same and len(x) > 1:
                        yield x, x, None, 0.0, np.triu_indices(len(x), 1)
                    yield from strips(whole, x, int(starts[np.searchsorted(firsts, ids[0]) + 1]) if same else 0)
                return
            for ids, a, _ in lefts:
                for ids2, b, _ in rights:
                    keep = np.broadcast_to(admit(ids[:, None], ids2[None, :]), (len(ids), len(ids2)))
                    i, j = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
                    if len(i):
                        keep = keep[np.ix_(i, j)]
                        if keep.all():
                            yield from strips(Single(b[j]), a[i])
                        else:
                            yield a[i], b[j], None, 0.0, np.nonzero(keep)

        def cell(lefts, rights, same):
            yield reduce_tiles(tiles(lefts, rights, same))

        return cell

    def _each(self, reduce_values: Callable, schema: str) -> DataFrame:
        """``reduce_values`` of the distances of a cell of the grid, which come in pieces."""
        admit, norm = self.admit, self.norm
        if norm != "l1":
            return block_cells(self.blocks, self.blocks, self._tiled(reduce_values), schema, half=admit is None)
        admit = admit or np.less

        def values(lefts, rights):
            for ids, a, _ in lefts:
                for ids2, b, _ in rights:
                    keep = np.broadcast_to(admit(ids[:, None], ids2[None, :]), (len(ids), len(ids2)))
                    i, j = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
                    if len(i):
                        d = distances(a[i], b[j], norm)  # rows and columns without a pair are left out before
                        keep = keep[np.ix_(i, j)]
                        yield d.ravel() if keep.all() else d[keep]

        def cell(lefts, rights, _):
            yield reduce_values(values(lefts, rights))

        return block_cells(self.blocks, self.blocks, cell, schema)

    def ends(self) -> tuple[int, int, float, float]:
        """Number of distances, of zeros among them, and the least and greatest that is not zero."""
        if self.norm != "l1":
            return self._square_ends()

        def reduce_values(pieces):
            n, zeros, low, high = 0, 0, np.inf, -np.inf
            for d in pieces:
                n += len(d)
                if not d.min() > 0:
                    some = d[d != 0]
                    zeros += len(d) - len(some)
                    d = some
                if len(d):
                    low, high = min(low, d.min()), max(high, d.max())
            return {"n": [n], "z": [zeros], "lo": [low], "hi": [high]}

        row = self._each(reduce_values, "n bigint, z bigint, lo double, hi double").agg(F.sum("n"), F.sum("z"), F.min("lo"), F.max("hi")).first()
        return row[0] or 0, row[1] or 0, row[2], row[3]

    def _square_ends(self) -> tuple[int, int, float, float]:
        rows = self.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
        stride = max(1, rows * rows // (2 * GUESSES))

        def reduce_tiles(tiles):
            n, zeros, low, high, some, ahead = 0, 0, np.inf, -np.inf, [], 0
            for a, b, d, off, pairs in tiles:
                if d is None:
                    got = near_pairs(a, b, *pairs)
                    every = got
                else:
                    least, most, every = d.min(), d.max(), d.ravel()
                    if least <= off:
                        least = d[d > off].min(initial=np.inf)
                    if least <= low + off or most >= high - off or d.min() <= off:
                        i, j = np.nonzero((d <= max(off, min(low + off, least + 2 * off))) | (d >= max(high - off, most - 2 * off)))
                        got = near_pairs(a, b, i, j)
                    else:
                        got = np.empty(0)
                some.append(every[ahead::stride].astype(float))
                ahead = (ahead - every.size) % stride
                n += every.size
                zeros += np.count_nonzero(got == 0)
                got = got[got > 0]
                if len(got):
                    low, high = min(low, got.min()), max(high, got.max())
            return {"n": [n], "z": [zeros], "lo": [low], "hi": [high], "some": [np.concatenate([np.empty(0), *some]).tolist()]}

        got = self._each(reduce_tiles, "n bigint, z bigint, lo double, hi double, some array<double>").toArrow().to_pylist()  # a row for each cell
        self.guesses = np.sort(np.concatenate([np.empty(0), *(r["some"] for r in got)]))
        n, zeros = sum(r["n"] for r in got), sum(r["z"] for r in got)
        low, high = min((r["lo"] for r in got), default=np.inf), max((r["hi"] for r in got), default=-np.inf)
        self.known = n, zeros, low, high
        return n, zeros, float(np.sqrt(low)), float(np.sqrt(max(high, 0))) if n > zeros else high

    def _square_ranked(self, ranks: list[int]) -> dict[int, float]:
        """``ranked`` of Euclidean distances: a guess tells where the ranks lie; what is less is counted, what lies there is measured."""
        n, zeros, low, high = self.known

        def around(rank):
            share = (rank + zeros) / n
            ends = int((share - _MARGIN) * len(self.guesses)) - 1, int((share + _MARGIN) * len(self.guesses)) + 1
            return float(np.clip(self.guesses[ends[0]] if ends[0] >= 0 else low, low, high)), float(np.clip(self.guesses[ends[1]] if ends[1] < len(self.guesses) else high, low, high))

        groups: list[list] = []
        for rank in sorted(set(ranks)):
            lo, hi = around(rank)
            if groups and lo <= groups[-1][2]:
                groups[-1][0].append(rank)
                groups[-1][2] = max(hi, groups[-1][2])
            else:
                groups.append([[rank], lo, hi])
        found: dict[int, float] = {}
        for some, lo, hi in groups:
            found |= self._between(some, lo, hi)
        return {r: sqrt(v) for r, v in found.items()}

    def _between(self, ranks: list[int], lo: float, hi: float) -> dict[int, float]:
        """Squares of the distances of these ranks, if they lie from ``lo`` to ``hi``; what does not is sought in the rest."""
        _, zeros, low, high = self.known
        fine = lo < hi and np.isfinite(_BINS / (hi - lo)) and lo + (hi - lo) / _BINS > lo

        def inside(tiles, start, end, below):
            for a, b, d, off, pairs in tiles:
                if d is None:
                    got = near_pairs(a, b, *pairs)
                else:
                    surely, maybe = d < start - off, d <= end + off
                    below[0] += np.count_nonzero(surely)
                    at = np.flatnonzero(surely ^ maybe)
                    if not len(at):
                        continue
                    got = near_pairs(a, b, *np.divmod(at, d.shape[1]))
                below[0] += np.count_nonzero(got < start)
                got = got[(got >= start) & (got <= end)]
                if len(got):
                    yield got

        def count(tiles):
            n, below = np.zeros(_BINS, dtype=np.int64), [0]
            for d in inside(tiles, lo, hi, below):
                n += np.bincount(_bin(d, lo, hi), minlength=_BINS)
            some = np.flatnonzero(n)
            return {"v": [-1, *some.tolist()], "n": [below[0], *n[some].tolist()]}

        def values(start, end, bins, tiles):
            v, n, below = np.empty(0), np.empty(0), [0]
            for d in inside(tiles, start, end, below):
                d = d[np.isin(_bin(d, lo, hi), bins)] if len(bins) else d
                v, back = np.unique(np.concatenate([v, d]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, np.ones(len(d))]), minlength=len(v))
            return {"v": [-1.0, *v.tolist()], "n": [below[0], *n.astype(np.int64).tolist()]}

        def totals(reduce_tiles, kind):
            got = self._each(reduce_tiles, f"v {kind}, n bigint").groupBy("v").agg(F.sum("n").alias("n")).toArrow()
            v, n = (got.column(c).to_numpy() for c in ("v", "n"))
            order = np.argsort(v)
            return v[order][1:], n[order][1:], int(n[order][:1].sum()) - zeros

        v, n, below = totals(count, "bigint") if fine else totals(partial(values, lo, hi, ()), "double")
        upto = below + np.cumsum(n)
        last = int(upto[-1]) if len(upto) else below
        found: dict[int, float] = {}
        less, more = [r for r in ranks if r < below], [r for r in ranks if r >= last]
        if less:
            found |= self._between(less, low, lo) if lo > low else dict.fromkeys(less, low)
        if more:
            found |= self._between(more, hi, high) if hi < high else dict.fromkeys(more, high)
        ranks = [r for r in ranks if below <= r < last]
        if not ranks:
            return found
        place = np.searchsorted(upto, ranks, side="right")
        if not fine:
            return found | dict(zip(ranks, v[place].tolist(), strict=True))
        width, edge = (hi - lo) / _BINS, 1e-9 * (hi - lo) / _BINS + 1e-15 * hi
        ends = lambda k: (max(lo, lo + width * v[k] - edge), min(hi, lo + width * (v[k] + 1) + edge))
        few = [k for k in sorted(set(place.tolist())) if n[k] <= FINE]
        if few:  # the values of all these bins in one pass
            got, m, _ = totals(partial(values, ends(few[0])[0], ends(few[-1])[1], v[few]), "double")
            sums = np.cumsum(m)
            start = dict(zip(few, np.cumsum([0] + [n[k] for k in few]).tolist(), strict=False))
        for k in sorted(set(place.tolist())):
            wanted = [r for r, p in zip(ranks, place, strict=True) if p == k]
            if k in few:
                local = [start[k] + r - int(upto[k] - n[k]) for r in wanted]
                found |= dict(zip(wanted, got[np.minimum(np.searchsorted(sums, local, side="right"), len(got) - 1)].tolist(), strict=True))
            else:
                found |= self._between(wanted, *ends(k))
        return found

    def at(self, rank: int, low: float, high: float) -> float:
        """The value of a rank (from 0) among the distances that are not zero, which lie from ``low`` to ``high``."""
        return self.ranked([rank], low, high)[0]

    def ranked(self, ranks: list[int], low: float, high: float, within: tuple = ()) -> list[float]:
        """The values of ranks among the distances that are not zero, which lie from ``low`` to ``high``.

        Histograms narrow the range until few values are left, which are then ranked.
        ``within``: bins of wider histograms, (low, high, bins), that hold the values.
        """
        if not low < high:
            return [float(low)] * len(ranks)
        if self.norm != "l1":
            if self.known is None:
                self.ends()
            found = self._square_ranked(ranks)
            return [found[r] for r in ranks]
        fine = np.isfinite(_BINS / (high - low)) and low + (high - low) / _BINS > low

        def inside(pieces, bins):
            for d in pieces:
                if not d.min() > 0:
                    d = d[d != 0]
                for lo, hi, some in bins:
                    at = _bin(d, lo, hi)
                    d = d[np.logical_or.reduce([at == k for k in some])]
                if len(d):
                    yield d

        def count(pieces):
            n = np.zeros(_BINS, dtype=np.int64)
            for d in inside(pieces, within):
                n += np.bincount(_bin(d, low, high), minlength=_BINS)
            some = np.flatnonzero(n)
            return {"v": some, "n": n[some]}

        def values(bins, pieces):
            v, n = np.empty(0), np.empty(0, dtype=np.int64)
            for d in inside(pieces, bins):
                v, back = np.unique(np.concatenate([v, d]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, np.ones(len(d))]), minlength=len(v)).astype(np.int64)
            return {"v": v, "n": n}

        def totals(reduce_values, kind):
            got = self._each(reduce_values, f"v {kind}, n bigint").groupBy("v").agg(F.sum("n").alias("n")).toArrow()
            v, n = (got.column(c).to_numpy() for c in ("v", "n"))
            order = np.argsort(v)
            return v[order], n[order], np.cumsum(n[order])

        # what comes to the driver is at most FINE values, or one value and its neighbours
        v, n, upto = totals(count, "bigint") if fine else totals(partial(values, within), "double")
        place = np.minimum(np.searchsorted(upto, ranks, side="right"), len(v) - 1)
        if not fine:
            return v[place].tolist()
        found: dict[int, float] = {}
        few = [k for k in sorted(set(place.tolist())) if n[k] <= FINE]
        if few:  # the values of all these bins in one pass
            last, _, sums = totals(partial(values, (*within, (low, high, tuple(v[few].tolist())))), "double")
            start = dict(zip(few, np.cumsum([0] + [n[k] for k in few]).tolist(), strict=False))
        width = (high - low) / _BINS
        for k in sorted(set(place.tolist())):
            wanted = [r for r, p in zip(ranks, place, strict=True) if p == k]
            local = [r - int(upto[k] - n[k]) for r in wanted]
            if k in few:
                got = last[np.minimum(np.searchsorted(sums, [start[k] + r for r in local], side="right"), len(last) - 1)].tolist()
            else:
                got = self.ranked(local, low + width * v[k], min(high, low + width * (v[k] + 1)), (*within, (low, high, (int(v[k]),))))
            found |= dict(zip(wanted, got, strict=True))
        return [found[r] for r in ranks]


def _bin(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins of equal width from ``low`` to ``high``; what lies beyond an end is in the bin next to it."""
    return np.clip((d - low) * (_BINS / (high - low)), 0, _BINS - 1).astype(np.int64)


def bandwidth_grid(d: Distances, number: int = 10) -> np.ndarray:
    """Geometric grid from half the least to twice the greatest distance, with floors for tiny distances; a distance of zero counts as the median."""
    n, zeros, low, high = d.ends()
    if n == zeros:
        low = high = 0.0
    else:
        # the median of all distances, zeros among them, takes the zeros' place
        ranks = ((n - 1) // 2, n // 2)
        fifth = int(0.05 * n)
        wanted = sorted({r for r in (*(r - zeros for r in ranks if zeros), *((fifth, fifth - zeros) if low < 0.1 else ())) if 0 <= r < n - zeros})
        known = dict(zip(wanted, d.ranked(wanted, low, high) if wanted else [], strict=True))
        value = lambda r: known[r] if r in known else d.at(r, low, high)
        middle = np.mean([0.0 if r < zeros else value(r - zeros) for r in ranks]) if zeros else 0.0
        least, greatest = (min(low, middle), max(high, middle)) if zeros else (low, high)
        if least < 0.1:
            rank = fifth
            if zeros and middle > 0:  # order of the values once the zeros stand at the median
                below = (n + 1) // 2 - zeros
                rank, fixed = (rank, None) if rank < below else (0, middle) if rank < below + zeros else (rank - zeros, None)
                least = max(fixed if fixed is not None else value(rank), 0.1)
            else:
                least = max(0.0 if rank < zeros else value(rank - zeros), 0.1)
        low, high = least, greatest
    low, high = (max(low, 0.1) if low < 0.1 else low) / 2, max(high, 0.3) * 2
    return low * (high / low) ** (np.arange(number) / (number - 1))


def weights(number: int, kind: str = "uniform") -> np.ndarray:
    """Weights of the bandwidths, summing to one."""
    i = np.arange(1, number + 1)
    raw = {
        "uniform": np.ones(number),
        "decreasing": 1 / i,
        "increasing": 1 / (number + 1 - i),
        "centred": 1 / (np.abs((number + 1) / 2 - i) + (1.0 if number % 2 else 0.5)),
    }[kind]
    return raw / raw.sum()


def median_heuristic(blocks: DataFrame) -> float:
    """Root of half the median of the non-zero squared distances of all rows; 1 if there are none."""
    d = Distances(blocks)
    n, zeros, low, high = d.ends()
    n -= zeros
    if not n:
        return 1.0
    return sqrt(np.mean(np.square(d.ranked([(n - 1) // 2, n // 2], low, high))) / 2)


#: Makes the resamples' values of the rows of a block: (ids) -> rows by resamples.
Design = Callable[[np.ndarray], np.ndarray]


def wild(seed: int, draws: int) -> Design:
    """Random signs, one for each pair of rows of the same number, negative on the second sample; the first column has no change of sign."""

    def values(ids: np.ndarray) -> np.ndarray:
        rows, back = np.unique(ids // 2, return_inverse=True)
        signs = np.array([np.random.default_rng([seed, int(r)]).integers(0, 2, draws) * 2 - 1 for r in rows], dtype=float)
        signs = np.concatenate([np.ones((len(rows), 1)), signs], axis=1)
        return signs[back] * np.where(ids % 2 == 0, 1.0, -1.0)[:, None]

    return values


def gaussian(seed: int, draws: int) -> Design:
    """Standard normal values, one for each row."""

    def values(ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), draws))
        for i, row in zip(ids, out, strict=True):
            np.random.default_rng([seed, int(i)]).standard_normal(out=row)
        return out

    return values


def permuted(blocks: DataFrame, size: int, seed: int, draws: int, first: bool = True) -> Design:
    """1 for the rows that a permutation puts into the first sample of ``size`` rows, else 0; the first column, if wanted, is the sample itself.

    How many rows of each block that are is drawn here, a number for each block and
    resample; which ones follows from the seed and the block.
    """
    sizes = {r["ids"]: r["n"] for r in blocks.select(F.element_at("ids", 1).alias("ids"), F.size("ids").alias("n")).orderBy("ids").collect()}
    kept = np.random.default_rng(seed).multivariate_hypergeometric(list(sizes.values()), size, size=draws, method="marginals").T.astype("<i4")
    shares = dict(zip(sizes, kept, strict=True))

    def values(ids: np.ndarray) -> np.ndarray:
        place = np.random.default_rng([seed, 1, int(ids[0])]).random((len(ids), draws)).argsort(0).argsort(0)
        labels = (place < shares[int(ids[0])][None, :]).astype(float)
        return np.concatenate([(ids % 2 == 0)[:, None].astype(float), labels], axis=1) if first else labels

    return values


def forms(blocks: DataFrame, kernel: str, widths: np.ndarray, design: Design, drop: str = "none", right: str = "ones", least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every bandwidth and resample s: s'Ks, s'Kr and r'Kr, where r is one everywhere, or 1 on the first and -1 on the second sample.

    ``drop``: pairs that count as zero: none, a row with itself ("own"), or rows of the same number in whichever sample ("paired").
    K is symmetric, so every two blocks meet once.  Where rows of the same number have
    opposite values, their four kernel values are summed before they are multiplied.
    ``least``: kernel values up to it may count as zero in s'Ks, where few are greater.
    """

    def cell(lefts, rights, same):
        rights = sorted(rights, key=lambda b: b[0][0])
        starts = np.cumsum([0] + [len(ids) for ids, _, _ in rights])
        ids2, x2 = np.concatenate([b[0] for b in rights]), np.concatenate([b[1] for b in rights])
        sign = lambda ids: np.ones(len(ids)) if right == "ones" else np.where(ids % 2 == 0, 1.0, -1.0)
        pairs = lambda ids: drop == "paired" and len(ids) % 2 == 0 and not (ids[::2] % 2).any() and (ids[::2] + 1 == ids[1::2]).all()
        opposite = lambda ids, s: pairs(ids) and np.array_equal(s[::2], -s[1::2])
        s2, folded = [], all(pairs(b[0]) for b in rights)
        for b in rights:
            s = design(b[0])
            if folded and not opposite(b[0], s):
                s2, folded = [np.stack([y, -y], 1).reshape(-1, y.shape[1]) for y in s2], False
            s2.append(s[::2].copy() if folded else s)
        s2, r2 = np.concatenate(s2), sign(ids2)
        q, line, c = np.zeros((len(widths), s2.shape[1])), np.zeros((len(widths), s2.shape[1])), np.zeros(len(widths))
        to_right = np.zeros((len(widths), len(ids2)))
        for ids, x, _ in lefts:
            s, r = design(ids), sign(ids)
            fold = folded and opposite(ids, s)
            s = s[::2] if fold else s
            # within one part, a block meets itself, which counts half, and those after it
            first = int(np.searchsorted([b[0][0] for b in rights], ids[0])) if same else 0
            total, to_left = np.zeros((len(widths), *s.shape)), np.zeros((len(widths), len(ids)))
            for low in range(starts[first], starts[-1], _WIDE):
                at = slice(low, min(low + _WIDE, starts[-1]))
                d = distances(x, x2[at], _norm(kernel))
                numbers = (ids, ids2[at]) if drop == "own" else (ids // 2, ids2[at] // 2)
                gone = np.nonzero(numbers[0][:, None] == numbers[1][None, :]) if drop != "none" else None
                own = min(max(starts[first + 1] - low, 0), at.stop - low) if same else 0
                for w, width in enumerate(widths):
                    k = kernel_of(kernel, d / width)
                    if gone is not None:
                        k[gone] = 0
                    if own:
                        k[:, :own] /= 2
                    to_left[w] += k @ r2[at]
                    to_right[w, at] += r @ k
                    if fold:
                        k = k[:, ::2] - k[:, 1::2]
                        k = k[::2] - k[1::2]
                        total[w] += k @ s2[at.start // 2 : at.stop // 2]
                    else:
                        if least and not folded:
                            i, j = np.nonzero(k > least)
                            if len(i) < k.size // _FEW:  # row by row, what is not zero
                                ends = np.searchsorted(i, np.arange(len(ids) + 1))
                                for row in np.flatnonzero(np.diff(ends)):
                                    some = j[ends[row] : ends[row + 1]]
                                    total[w, row] += k[row, some] @ s2[at.start + some]
                                continue
                        total[w] += k @ (np.repeat(s2[at.start // 2 : at.stop // 2], 2, 0) * np.where(ids2[at] % 2 == 0, 1.0, -1.0)[:, None] if folded else s2[at])
            for w in range(len(widths)):
                q[w] += 2 * np.einsum("ij,ij->j", s, total[w])
                line[w] += (to_left[w, ::2] - to_left[w, 1::2] if fold else to_left[w]) @ s
                c[w] += 2 * float(r @ to_left[w])
        line += (to_right[:, ::2] - to_right[:, 1::2] if folded else to_right) @ s2
        n = s2.shape[1]
        yield {"w": np.repeat(np.arange(len(widths)), n), "i": np.tile(np.arange(n), len(widths)), "q": q.ravel(), "l": line.ravel(), "c": np.repeat(c, n)}

    sums = block_cells(blocks, blocks, cell, "w bigint, i bigint, q double, l double, c double", half=True)
    rows = sums.groupBy("w", "i").agg(F.sum("q").alias("q"), F.sum("l").alias("l"), F.sum("c").alias("c")).collect()  # a row for each resample
    out = np.zeros((3, len(widths), max((r["i"] for r in rows), default=-1) + 1))
    for r in rows:
        out[:, r["w"], r["i"]] = r["q"], r["l"], r["c"]
    return out[0], out[1], out[2]


def elementwise_scale(real: DataFrame, synth: DataFrame, key: str, vector: str) -> float:
    """Median of the absolute differences of all components of rows at the same place."""
    a, b = numbered(real, key, vector), numbered(synth, key, vector).withColumnRenamed("v", "u")
    each = a.join(b, "_row").select(F.explode(F.zip_with("v", "u", lambda x, y: F.abs(x - y))).alias("d"))
    return (exact_quantiles(each, "d", [0.5]) or [0.0])[0] or 1.0


def _equal(sizes: list[int], what: str) -> int:
    if sizes[0] != sizes[1]:
        raise ValueError(f"the {what} test needs samples of equal size")
    return sizes[0]


def permutation_test(real: DataFrame, synth: DataFrame, key: str, vector: str, scale: float | None = None, resamples: int = 5000, level: float = 0.05, seed: int = 0) -> dict[str, float]:
    """Biased MMD under exp(-d^2 / (2 scale^2)) against permuted rows of the joint kernel matrix; equal sizes only.

    A draw permutes the rows and leaves the columns, as the reference's does, so it
    needs no more than every row's signed kernel sum: one pass over pairs, and another
    over rows for all draws.  Such draws spread less than those of permuted samples
    and the test rejects more often than its level; ``mmdagg`` holds its level.
    """
    blocks, sizes = pooled([real, synth], key, vector)
    m = _equal(sizes, "permutation")
    width = (scale or elementwise_scale(real, synth, key, vector)) * sqrt(2)

    def cell(lefts, rights, _):
        for ids, a, _ in lefts:
            yield {"id": ids, "s": sum(np.exp(-squares(a, b) / width**2) @ np.where(ids2 % 2 == 0, 1.0, -1.0) for ids2, b, _ in rights)}

    sums = block_cells(blocks, blocks, cell, "id bigint, s double").groupBy("id").agg(F.sum("s").alias("s"))
    design = permuted(blocks, m, seed, resamples)

    def total(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        ids, s = table.column("id").to_numpy()[order], table.column("s").to_numpy()[order]
        return pa.table({"i": np.arange(resamples + 1), "v": (2 * design(ids) - 1).T @ s})

    by_block = blocks.select("block", F.explode("ids").alias("id")).join(sums, "id").groupBy("block").applyInArrow(total, "i bigint, v double")
    draws = np.zeros(resamples + 1)
    for r in by_block.groupBy("i").agg(F.sum("v").alias("v")).collect():
        draws[r["i"]] = r["v"] / m**2
    release(blocks)
    threshold = float(np.quantile(draws[1:], 1 - level))
    p = float((1 + (draws[1:] >= draws[0]).sum()) / (1 + resamples))
    return {"statistic": float(draws[0]), "threshold": threshold, "p_value": p, "reject": float(draws[0] > threshold)}


def spectral_test(real: DataFrame, synth: DataFrame, key: str, vector: str, scale: float | None = None, draws: int = 5000, level: float = 0.05, seed: int = 0) -> dict[str, float]:
    """M9: MMD test whose null distribution is the weighted sum of squares that the spectrum of the centred kernel matrix gives; equal sizes only.

    The matrix as a quadratic form of independent normal values has just that
    distribution, in whichever basis, so no eigenvalue is computed.  Kernel values
    whose sum over all pairs is less than a double's rounding of the diagonal's are
    not multiplied where few others are beside them.
    """
    blocks, sizes = pooled([real, synth], key, vector)
    m = _equal(sizes, "spectral")
    width = np.array([(scale or elementwise_scale(real, synth, key, vector)) * sqrt(2)])
    design = gaussian(seed, draws)
    q, line, every = (x[0] for x in forms(blocks, "gaussian", width, design, least=1e-16 / (2 * m) if m else 0.0))

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"i": np.arange(draws), "v": design(np.array(table.column("ids")[0].as_py())).sum(0)})

    mean = np.zeros(draws)
    for r in blocks.groupBy("block").applyInArrow(add, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        mean[r["i"]] = r["v"] / (2 * m)
    null = 2 * (q - 2 * mean * line + mean**2 * every) / (2 * m)
    statistic = float(forms(blocks, "gaussian", width, lambda ids: np.where(ids % 2 == 0, 1.0, -1.0)[:, None])[0][0, 0]) / m
    release(blocks)
    threshold = float(np.quantile(null, 1 - level))
    return {"statistic": statistic, "threshold": threshold, "p_value": float((null >= statistic).mean()), "reject": float(statistic > threshold)}


def boot_test(real: DataFrame, synth: DataFrame, key: str, vector: str, scheme: str = "permutation", level: float = 0.5, **options) -> dict[str, float]:
    """The test of a scheme, with the evaluator's level."""
    tests = {"permutation": permutation_test, "spectral": spectral_test}
    if scheme not in tests:
        raise ValueError(f"unknown scheme {scheme!r}")
    return tests[scheme](real, synth, key, vector, level=level, **options)


def mmdagg(
    real: DataFrame, synth: DataFrame, key: str, vector: str, kernel: str = "laplace_gaussian", number: int = 10, kind: str = "uniform",
    level: float = 0.05, b1: int = 2000, b2: int = 2000, b3: int = 50, seed: int = 42, permutations: bool = False,
) -> DataFrame:
    """Aggregated MMD test over kernels and bandwidths.

    Samples of equal size are resampled by a wild bootstrap (or, if asked for, by
    permutations), others by permutations.  Bandwidths come from the distances of
    real to synthetic rows.  Returns a row for each single test: kernel, bandwidth,
    statistic, p_value, threshold, reject_single and reject (of the whole test).  The
    level of the single tests is found by bisection so that the whole test has its
    level on a second set of resamples.  The wild bootstrap's values are computed in
    single precision with a bound and, where that leaves a rank open, in double.
    """
    spark = real.sparkSession
    blocks, (m, n) = pooled([real, synth], key, vector)
    kernels = COLLECTIONS.get(kernel, (kernel,))
    tests, grids = [], {}
    bootstrap = m == n and not permutations
    design = wild(seed, b1 + b2) if bootstrap else permuted(blocks, m, seed, b1 + b2)
    for name in kernels:
        norm = _norm(name)
        if norm not in grids:
            grids[norm] = bandwidth_grid(Distances(blocks, lambda a, b: (a % 2 == 0) & (b % 2 == 1), norm), number)
        tests += [(name, norm, float(b)) for b in grids[norm]]
    w = np.concatenate([weights(number, kind)] * len(kernels)) / len(kernels)
    found = aggregated(blocks, tests, kernel_of, design, m, m * (m - 1), w, b1, b3, level) if bootstrap else None
    if found is None:
        values = []
        for name in kernels:
            q, line, every = forms(blocks, name, grids[_norm(name)], design, "paired" if bootstrap else "own")
            if bootstrap:
                values.append(q / (m * (m - 1)))
            else:  # unbiased statistics from the sums within the first sample, of it with all rows, and of all rows
                values.append(q / (m * (m - 1)) + (every - 2 * line + q) / (n * (n - 1)) - 2 * (line - q) / (m * n))
        out = np.concatenate(values)
        found = out[:, 0], *settled(out, out, w, b1, b3, level)[0]
    release(blocks)
    observed, p, cut = found
    reject = bool((observed > cut).any())
    rows = [(k, b, float(s), float(q), float(c), bool(s > c), reject) for (k, _, b), s, q, c in zip(tests, observed, p, cut, strict=True)]
    return spark.createDataFrame(rows, "kernel string, bandwidth double, statistic double, p_value double, threshold double, reject_single boolean, reject boolean")


def mmdagg_evaluation(train: DataFrame, validation: DataFrame, synth: DataFrame, key: str, vector: str, **options) -> DataFrame:
    """Whether training and validation rows are told from synthetic ones, and the single tests' mean p-value: (metric, value)."""
    options.setdefault("kernel", "gaussian")
    parts = []
    for name, real in (("train", train), ("validation", validation)):
        row = mmdagg(real, synth, key, vector, **options).agg(F.avg("p_value"), F.max(F.col("reject").cast("double"))).first()
        parts += [(f"mmdagg_p_value_{name}", row[0]), (f"mmdagg_reject_{name}", row[1])]
    return synth.sparkSession.createDataFrame(parts, "metric string, value double")


def relative_test(real: DataFrame, first: DataFrame, second: DataFrame, key: str, vector: str, sigma: float | None = None) -> dict[str, float]:
    """Whether ``first`` or ``second`` is closer to ``real``; a p-value below the level says that ``first`` is not closer.

    Bounliphone et al. 2016: difference of two unbiased MMDs with a variance from
    the first-order terms of its U-statistic, from every row's kernel sums.
    """
    blocks, sizes = pooled([real, first, second], key, vector)
    sigma = sigma or median_heuristic(blocks)
    which = lambda ids: (ids[:, None] % 3 == np.arange(3)).astype(float)
    sums_of = lambda ids, total: {"id": ids} | {f"s{s}": total[:, s] for s in range(3)}

    def cell(lefts, rights, same):
        others = [which(b[0]) for b in rights]
        theirs = [np.zeros_like(o) for o in others]
        for ids, a, _ in lefts:
            own = which(ids)
            total = np.zeros((len(ids), 3))
            for at, (ids2, b, _) in enumerate(rights):
                if same and ids2[0] < ids[0]:
                    continue
                k = squares(a, b)
                k /= -2 * sigma**2
                np.exp(k, out=k)
                if same and ids2[0] == ids[0]:
                    np.fill_diagonal(k, 0)
                else:  # these two blocks meet once
                    theirs[at] += k.T @ own
                total += k @ others[at]
            yield sums_of(ids, total)
        for (ids2, _, _), total in zip(rights, theirs, strict=True):
            yield sums_of(ids2, total)

    sums = block_cells(blocks, blocks, cell, "id bigint, s0 double, s1 double, s2 double", half=True).groupBy("id").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(3)])
    m, n, r = sizes
    # first-order projections of the statistic onto one row of each sample
    h = F.when(F.col("id") % 3 == 0, F.col("s2") / r - F.col("s1") / n).when(F.col("id") % 3 == 1, F.col("s1") / (n - 1) - F.col("s0") / m).otherwise(F.col("s0") / m - F.col("s2") / (r - 1))
    rows = {x["k"]: x for x in sums.groupBy((F.col("id") % 3).alias("k")).agg(F.var_pop(h).alias("v"), *[F.sum(f"s{s}").alias(f"t{s}") for s in range(3)]).collect()}
    release(blocks)
    t = rows[1]["t1"] / (n * (n - 1)) - 2 * rows[0]["t1"] / (m * n) - rows[2]["t2"] / (r * (r - 1)) + 2 * rows[0]["t2"] / (m * r)
    variance = 4 * (rows[0]["v"] / m + rows[1]["v"] / n + rows[2]["v"] / r)
    score = t / sqrt(max(variance, 1e-300))
    return {"statistic": float(score), "p_value": 0.5 * (1 + erf(-score / sqrt(2))), "sigma": sigma}
