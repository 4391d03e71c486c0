"""Substring dedup (operator 7): paragraph MinHash banding and components.

Shared passages stand anywhere in a text, so paragraphs are cut by content, not
by position: a paragraph is the ``PARAGRAPH_WORDS`` words from an anchor on, and
the anchors are the words whose shingle hash is the smallest among any
``ANCHOR_SPAN`` consecutive ones.  Any run of at least ``PARAGRAPH_WORDS +
ANCHOR_SPAN - 1`` = 50 words that two documents share therefore holds the same
anchor, and the same paragraph, in both.

* Paragraphs of the same words are one content; only contents are compared.
* MinHash over a paragraph's five-word shingles, in ``BANDS`` bands of ``ROWS``
  hashes: contents of Jaccard similarity 0.8 collide in a band with probability
  0.95, those of 0.9 with 0.99.
* Colliding contents are compared exactly, in bounded cells (``blocks``); a link
  needs a Jaccard similarity of 0.8.
* Contents that links connect are one cluster.  A cluster that occurs in two or
  more documents stays in the smallest doc_id among them and is a repeat in all
  others.
* A repeat grows word by word to both sides while its words are those beside a
  paragraph of its cluster in the document that keeps it.  Within a shared run the
  next anchor is at most ``ANCHOR_SPAN`` words away, so as many words on each side
  reach the run's real ends.  The grown repeats of a document that touch are one
  passage.

Bands are compared by 32 bits within a hash fragment: what collides by chance
fails the exact comparison.  All pieces that move are packed arrays.

Cases: null and empty texts and texts of fewer words than a paragraph have no
paragraphs; rows without doc_id are left out; rows that share a doc_id are one
document, and where their texts differ each has the spans that are its own; a
passage repeated within one document only is no repeat; a very long text goes
through whole; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.blocks import link_clusters
from trialspark.llm.hashing import Words, combine, mix64
from trialspark.llm.shared import column_of, connected_components, documents_of, fragments_for, free_name, materialise, release, text_batches, trim

PARAGRAPH_WORDS = 25
ANCHOR_SPAN = 26
SHINGLE = 5
BANDS, ROWS = 3, 2
PERCENT = 80
#: Paragraphs of a cluster that grow in one cell.
CHUNK = 1024
_SHINGLES = PARAGRAPH_WORDS - SHINGLE + 1
_SALTS = np.random.default_rng(5).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 22) - 1)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the paragraphs' first words; ``first`` has the offsets of the texts' words."""
    n = np.diff(first)
    starts = n - PARAGRAPH_WORDS + 1  # possible first words of a text
    size = int(first[-1])
    key = np.full(size, _MAX, dtype=np.uint64)
    if not (starts > 0).any():
        return np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(size) - first[owner]
    valid = np.flatnonzero(within < starts[owner])
    key[valid] = (shingles[valid] & ~_PLACE) | (valid.astype(np.uint64) & _PLACE)
    found = []
    if size >= ANCHOR_SPAN:
        low = _sliding_min(key, ANCHOR_SPAN)
        left = np.arange(len(low))
        inside = within[left] + ANCHOR_SPAN <= starts[owner[left]]
        left, low = left[inside], low[inside]
        found.append(left + ((low - left.astype(np.uint64)) & _PLACE).astype(np.int64))
    for i in np.flatnonzero((starts > 0) & (starts < ANCHOR_SPAN)):  # fewer starts than a span: their smallest
        found.append(np.array([first[i] + int(np.argmin(key[first[i] : first[i] + starts[i]]))]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


class Paragraphs:
    """Paragraphs of a batch of texts: owner, byte span, content hash, shingles."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        h = self.words.hash
        self.shingles = combine(h, SHINGLE)
        padded = np.concatenate([self.shingles, np.full(len(h) - len(self.shingles), _MAX, dtype=np.uint64)])
        self.at = anchors(padded, self.words.first)
        self.owner = np.searchsorted(self.words.first, self.at, side="right") - 1
        offset = self.words.text_start[self.owner]
        self.start = self.words.start[self.at] - offset
        self.end = self.words.end[self.at + PARAGRAPH_WORDS - 1] - offset
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.shingles), dtype=np.uint64)])
        if len(self.at):
            self.content = mix64(total[self.at + _SHINGLES] - total[self.at] + self.shingles[self.at]).view(np.int64)
            self._merge()
        else:
            self.content = np.empty(0, dtype=np.int64)

    def _merge(self) -> None:
        """Overlapping paragraphs of one text with the same words (text that repeats itself) become one."""
        order = np.lexsort((self.at, self.content, self.owner))
        at, content, owner = self.at[order], self.content[order], self.owner[order]
        new = (content[1:] != content[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > PARAGRAPH_WORDS)
        first = order[np.concatenate([[True], new])]
        last = order[np.concatenate([new, [True]])]
        by = np.argsort(self.at[first], kind="stable")
        first, last = first[by], last[by]
        self.end = self.end[last]
        self.at, self.start, self.owner, self.content = self.at[first], self.start[first], self.owner[first], self.content[first]

    def bands(self) -> np.ndarray:
        """Band hashes, one row for each band."""
        out = np.empty((BANDS, len(self.at)), dtype=np.uint64)
        if not len(self.at):
            return out
        for b in range(BANDS):
            acc = np.full(len(self.at), b + 1, dtype=np.uint64)
            for salt in _SALTS[b * ROWS : (b + 1) * ROWS]:
                acc = mix64(acc * salt + _sliding_min(self.shingles * salt, _SHINGLES)[self.at])
            out[b] = acc
        return out

    def items(self, i: int) -> np.ndarray:
        """Shingles of a paragraph, by 32 bits of their hashes."""
        return np.unique((self.shingles[self.at[i] : self.at[i] + _SHINGLES] >> np.uint64(32)).astype("<u4"))


def _cut(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            p = Paragraphs(texts)
            k = len(p.at)
            if not k:
                continue
            number = uuid.uuid4().int >> 66  # written once with all its rows, so any name will do
            ids = column_of(batch, "doc_id")[p.owner]
            table = ids.astype("<i8").tobytes() + p.content.astype("<i8").tobytes() + p.start.astype("<i8").tobytes() + p.end.astype("<i8").tobytes()
            rows = [(-1, table)]
            fingerprint = (p.content.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype("<u4")
            for b, h in enumerate(p.bands()):
                fragment = (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(fragment, kind="stable")
                cut = np.searchsorted(fragment[order], np.arange(fragments + 1))
                low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
                for f in np.flatnonzero(np.diff(cut)).tolist():
                    o = order[cut[f] : cut[f + 1]]
                    rows.append((f * BANDS + b, low[o].tobytes() + fingerprint[o].tobytes() + o.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                names=["fragment", "batch", "piece"],
            )

    return run


def _collide(table: pa.Table) -> pa.Table:
    """Places of a fragment's repeated contents (key 0, from the first band) and of contents that share a band (key > 0)."""
    fragment = table.column("fragment")[0].as_py()
    band, content, place, source = [], [], [], []
    for k, piece in enumerate(table.column("piece").to_pylist()):
        a = np.frombuffer(piece, "<u4").reshape(3, -1)
        band.append(a[0])
        content.append(a[1])
        place.append(a[2])
        source.append(np.full(a.shape[1], k))
    band, content, place, source = map(np.concatenate, (band, content, place, source))
    key = band.astype(np.uint64) << np.uint64(32) | content
    order = np.argsort(key, kind="stable")
    key, place, source = key[order], place[order], source[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # distinct contents of a band hash
    runs = np.diff(np.append(heads, len(key)))
    group = (key >> np.uint64(32))[heads]
    first_of_band = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    many = np.diff(np.append(first_of_band, len(heads)))
    # a group is named by its contents, so that bands which find the same group name it alike
    name = np.add.reduceat(mix64(key[heads] & np.uint64(0xFFFFFFFF)), first_of_band)
    name = (mix64(name + many.astype(np.uint64)) >> np.uint64(2)).astype(np.int64) + 1
    contents = np.repeat(many, many)
    near = heads[contents > 1]
    same = np.flatnonzero(np.repeat(runs > 1, runs)) if fragment % BANDS == 0 else np.empty(0, dtype=np.int64)
    at = np.concatenate([same, near])
    keys = np.concatenate([np.zeros(len(same), dtype=np.int64), np.repeat(name, many)[contents > 1]])
    by = np.argsort(source[at], kind="stable")
    at, keys = at[by], keys[by]
    out_batch, out_piece = [], []
    numbers = table.column("batch").to_pylist()
    cuts = np.searchsorted(source[at], np.arange(len(numbers) + 1))
    for k, number in enumerate(numbers):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            out_batch.append(number)
            out_piece.append(keys[a:b].astype("<i8").tobytes() + place[at[a:b]].astype("<i8").tobytes())
    return pa.table({"batch": pa.array(out_batch, pa.int64()), "found": pa.array(out_piece, pa.binary())})


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was found in a batch: each of its places once (key 0: its content is repeated, -1: only near others), and the groups of near contents (key > 0)."""
    for batch in batches:
        for piece, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = np.frombuffer(piece, "<i8").reshape(4, -1)
            key, place = np.concatenate([np.frombuffer(f, "<i8").reshape(2, -1) for f in found], axis=1)
            spot = np.unique(place)
            repeated = np.isin(spot, place[key == 0])
            near = np.stack([key, table[1][place]])[:, key > 0]
            near = near[:, np.lexsort(near)]
            near = near[:, np.concatenate([[True], (near[:, 1:] != near[:, :-1]).any(0)])] if near.size else near
            none = np.full(near.shape[1], -1)
            # a near content's row names the first document that has it, whose text gives its shingles
            order = np.lexsort((table[0][spot], table[1][spot]))
            contents, first = np.unique(table[1][spot][order], return_index=True)
            holder = table[0][spot][order][first[np.searchsorted(contents, near[1])]]
            columns = [
                np.concatenate(x) for x in ((np.where(repeated, 0, -1), near[0]), (table[1][spot], near[1]), (table[0][spot], holder), (table[2][spot], none), (table[3][spot], none))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "content", "doc_id", "start", "stop"])


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the wanted paragraphs (``wanted``: content hashes) of every text."""
    for batch, texts in text_batches(batches):
        p = Paragraphs(texts)
        wanted = [set(w) for w in batch.column(batch.schema.get_field_index("wanted")).to_pylist()]
        rows = {}
        for i in range(len(p.at)):
            c = int(p.content[i])
            if c in rows or c not in wanted[p.owner[i]]:
                continue
            rows[c] = p.items(i).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["uid", "items"])


def _contents(h: np.ndarray) -> np.ndarray:
    """Content hashes of paragraphs, from rows of the hashes of their words."""
    at = np.arange(len(h))[:, None] * PARAGRAPH_WORDS + np.arange(_SHINGLES)
    shingles = combine(h.ravel(), SHINGLE)[at]
    return mix64(mix64(shingles).sum(1, dtype=np.uint64) + shingles[:, 0]).view(np.int64)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words beside the spots of every text, and for repeats the bytes from the spot to the far end of each.

    The hashes go outwards from the spot's own first and last word; beyond the text stands 0, in a kept text 1.
    """
    steps = np.arange(ANCHOR_SPAN + 1)
    for batch, texts in text_batches(batches):
        words = Words(texts)
        spots = batch.column(batch.schema.get_field_index("spots"))
        owner = np.repeat(np.arange(len(texts)), np.diff(spots.offsets.to_numpy()))
        cluster, content, start, stop, kept_in, chunks = (x.to_numpy(zero_copy_only=False) for x in spots.flatten().flatten())
        ids = column_of(batch, "doc_id")[owner]
        offset = words.text_start[owner]
        first, last = np.searchsorted(words.start, offset + start), np.searchsorted(words.end, offset + stop)
        # rows that share a doc_id: only the text that has the paragraph where the spot says
        here = (first + PARAGRAPH_WORDS <= words.first[owner + 1]) & (last < words.first[owner + 1])
        i = np.flatnonzero(here)
        here[i] = (words.start[first[i]] == offset[i] + start[i]) & (words.end[last[i]] == offset[i] + stop[i])
        i = np.flatnonzero(here)
        i = i[_contents(words.hash[first[i, None] + np.arange(PARAGRAPH_WORDS)]) == content[i]] if len(i) else i
        if not len(i):
            continue
        kept = ids[i] == kept_in[i]
        hashes = np.maximum(words.hash >> np.uint64(32), 2).astype("<u4")
        sides, reach = [], []
        for at, far, edge in ((first[i, None] - steps, words.start, start), (last[i, None] + steps, words.end, stop)):
            inside = (at >= words.first[owner[i], None]) & (at < words.first[owner[i] + 1, None])
            at = np.where(inside, at, first[i, None])
            sides.append(np.where(inside, hashes[at], kept[:, None]).astype("<u4"))
            reach.append(np.abs(far[at] - (offset[i] + edge[i])[:, None]).astype("<u4"))
        both = np.concatenate(reach, axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[i]) for x in (cluster, ids, column_of(batch, "print")[owner], start, stop, kept_in, chunks)]
            + [pa.array([x.tobytes() for x in side], pa.binary()) for side in sides]
            + [pa.array([b"" if k else x.tobytes() for k, x in zip(kept, both, strict=True)], pa.binary())],
            names=["cluster", "doc_id", "print", "start", "stop", "kept_in", "chunks", "before", "after", "reach"],
        )


def _longest(cell: np.ndarray, sides: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Words that every repeat has in common with a kept side of its cell, the one it shares most with; less the spot's own."""
    key = np.concatenate([cell.astype(">i8").view(">u4").reshape(-1, 2), sides.astype(">u4")], axis=1)
    flat = np.ascontiguousarray(key).view(f"S{4 * key.shape[1]}").ravel()
    kept = np.flatnonzero(~repeat)
    kept = kept[np.argsort(flat[kept])]
    at, best = np.searchsorted(flat[kept], flat[repeat]), np.zeros(int(repeat.sum()), dtype=np.int64)
    if not len(kept):
        return best
    for near in (at - 1, at):  # in order, the longest common start is with a neighbour
        other = kept[np.clip(near, 0, len(kept) - 1)]
        # the own word has to agree too: paragraphs that are only similar may be shifted
        best = np.maximum(best, np.cumprod(key[repeat] == key[other], axis=1).sum(1) - 3)
    return best


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grown spans of repeats; the rows of a cell, its kept sides among them (no reach), arrive in a row."""
    names = ["doc_id", "print", "start", "stop", "cluster", "kept_in"]

    def grown(table: pa.Table) -> pa.RecordBatch:
        cell = table.column("cell").to_numpy()
        matrix = lambda t, name: np.frombuffer(b"".join(t.column(name).to_pylist()), "<u4").reshape(t.num_rows, -1 if t.num_rows else 1)
        repeat = table.column("doc_id").to_numpy() != table.column("kept_in").to_numpy()
        if not repeat.any():
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 6, names=names)
        left, right = (_longest(cell, matrix(table, name), repeat) for name in ("before", "after"))
        some = table.filter(pa.array(repeat))
        reach, rows = matrix(some, "reach").astype(np.int64), np.arange(some.num_rows)
        first = some.column("start").to_numpy() - reach[rows, left]
        last = some.column("stop").to_numpy() + reach[rows, ANCHOR_SPAN + 1 + right]
        ids, text, cluster, kept_in = (some.column(n).to_numpy() for n in ("doc_id", "print", "cluster", "kept_in"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, text, first, last, cluster, kept_in)], names=names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
        if cell[0] != cell[-1]:
            done = int(np.searchsorted(cell, cell[-1]))
            yield grown(pa.Table.from_batches([*held[:-1], batch.slice(0, done)]))
            held = [batch.slice(done)]
    if held:
        yield grown(pa.Table.from_batches(held))
    held.clear()
    trim()


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated paragraphs, grown: (doc_id, print, start, stop, cluster, kept_in), bytes of the UTF-8 text.

    ``kept_in`` is the smallest doc_id of the cluster; the document of that id keeps
    the passage and has no row.  ``print`` is the xxhash64 of the text, which tells
    rows of one doc_id apart.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fragments = fragments_for(docs)
    cut = materialise(docs.mapInArrow(_cut(fragments), "fragment int, batch bigint, piece binary"), "paragraphs")
    found = cut.where("fragment >= 0").groupBy("fragment").applyInArrow(_collide, "batch bigint, found binary")
    found = found.groupBy("batch").agg(F.collect_list("found").alias("found"))
    tables = cut.where("fragment < 0").select("batch", "piece")
    places = materialise(
        tables.join(found, "batch").select("piece", "found").mapInArrow(_resolve, "key bigint, content bigint, doc_id bigint, start bigint, stop bigint"),
        "paragraph-places",
    )
    release(cut)
    near = materialise(places.where("key > 0").groupBy("key", "content").agg(F.min("doc_id").alias("doc_id")), "near-contents")
    wanted = near.groupBy("content").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("content").alias("wanted"))
    sets = materialise(docs.join(wanted.hint("merge"), "doc_id").mapInArrow(_item_sets, "uid bigint, items binary"), "paragraph-sets")
    links = link_clusters(near.select(F.col("key").alias("cluster"), F.col("content").alias("uid")).join(sets, "uid"), PERCENT, "<u4", ranges=1)
    release(near, sets)
    labels = connected_components(links)
    release(links)
    named = labels.select(F.col("node").alias("content"), F.col("component").alias("cluster"))
    columns = ["cluster", "content", "doc_id", "start", "stop"]
    spots = places.where("key = 0").join(named, "content", "left").withColumn("cluster", F.coalesce("cluster", "content")).select(*columns)
    spots = materialise(spots.union(places.where("key = -1").join(named, "content").select(*columns)), "paragraph-spots")
    release(places, labels)
    kept = spots.groupBy("cluster").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size"))
    kept = kept.where("kept_in < last").select("cluster", "kept_in", F.ceil(F.col("size") / CHUNK).cast("bigint").alias("chunks"))
    kept = materialise(kept, "paragraph-clusters")  # so that the join can split a common passage
    listed = spots.join(kept, "cluster").groupBy("doc_id").agg(F.collect_set(F.struct("cluster", "content", "start", "stop", "kept_in", "chunks")).alias("spots"))
    beside = docs.withColumn("print", F.xxhash64("text")).join(listed.hint("merge"), "doc_id").mapInArrow(
        _beside, "cluster bigint, doc_id bigint, print bigint, start bigint, stop bigint, kept_in bigint, chunks bigint, before binary, after binary, reach binary"
    )
    beside = materialise(beside, "paragraph-sides")
    release(spots, kept)
    # the repeats of a cluster are dealt to chunks of bounded size, and its kept sides go to each
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.col("chunks"))
    dealt = beside.withColumn("chunk", F.explode(F.when(F.col("doc_id") == F.col("kept_in"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array(chunk))))
    columns = ["doc_id", "print", "start", "stop", "cluster", "kept_in", "before", "after", "reach"]
    dealt = dealt.select(F.xxhash64("cluster", "chunk").alias("cell"), *columns).repartition(fragments, "cell").sortWithinPartitions("cell")
    out = materialise(dealt.mapInArrow(_grow, "doc_id bigint, print bigint, start bigint, stop bigint, cluster bigint, kept_in bigint"), "repeats")
    release(beside)
    return out


def _merged(docs: DataFrame) -> DataFrame:
    """Repeated passages by text: touching repeats as one, (doc_id, print, start, stop, kept_in, paragraphs)."""
    found = repeats(docs)
    order = Window.partitionBy("doc_id", "print").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "print", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_in").alias("kept_in"), F.size(F.collect_set(F.struct("start", "stop", "cluster"))).cast("bigint").alias("paragraphs")
    )
    out = materialise(runs.drop("run"), "passages")
    release(found)
    return out


def passages(docs: DataFrame) -> DataFrame:
    """Repeated passages: (doc_id, start, stop, kept_in, paragraphs), bytes of the UTF-8 text; of rows that share a doc_id, those of each text."""
    return _merged(docs).drop("print")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all repeated passages cut out of ``text``; every row stays, and a row's cuts are those of its own text."""
    spans = _merged(docs).groupBy("doc_id", "print").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    schema = T.StructType(docs.schema.fields)
    width, at_text = len(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(at_text).to_pylist(), batch.column(width).to_pylist(), strict=True):
                if cuts:
                    raw, out, at = text.encode("utf-8"), [], 0
                    for c in cuts:
                        out.append(raw[at : c["start"]].rstrip(b" "))
                        at = c["stop"]
                    out.append(raw[at:])
                    text = b"".join(out).decode("utf-8")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at_text else batch.column(k) for k in range(width)], names=schema.names)

    joined = docs.join(spans, docs["doc_id"].cast("bigint").eqNullSafe(spans["doc_id"]) & (F.xxhash64(docs["text"]) == spans["print"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], spans["_cuts"].alias(free_name(docs, "_cuts"))).mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents_of(spark, sf_dir))
