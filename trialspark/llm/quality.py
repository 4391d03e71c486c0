"""Quality classifier (operator 4): random-indexing word vectors and a small network.

Every word and every word shape (case, punctuation, symbols, length, repetition)
is an item of a fixed hashed vocabulary with a sparse ternary index vector.  The
context vector of an item is the sum of the index vectors of the items around
it, summed over the training texts; a document is the mean of the context
vectors of its words, next to a few rates.  A two-layer network maps that to a
logit, and one temperature, fitted on training rows that the network did not
see, calibrates its probabilities.

The fit takes at most ``MAX_TRAINING`` labelled documents (the first in the order
of a hash of their ids); scoring reads every text whole.

Cases: null and empty texts are documents without words and get the score that
the network gives to such; documents with several labels take the highest; null
labels and labels without a document train nothing; without labels of both
classes the score is the share of label 1 (0.5 without any).  Repeated rows are
scored alike; of rows that share a doc_id the fit takes the first text in order.
A very long text is read whole; further columns are kept by ``score``, which
takes another name for its own column where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.hashing import mix64, word_spans
from trialspark.llm.hashing import _span_hash as span_hash
from trialspark.llm.shared import documents_of, materialise, release, text_batches

#: Bound on the labelled documents that the fit reads.
MAX_TRAINING = 6000
#: Score from which a document is predicted to be of good quality.
THRESHOLD = 0.3
WORDS, SHAPES, DIMENSIONS = 1 << 14, 1 << 10, 32
_CONTEXT = 2

_CLASS = np.zeros(256, dtype=np.int8)  # 0 space, 1 upper, 2 lower and other letters, 3 digit, 4 closing punctuation, 5 symbol
_CLASS[33:] = 2
_CLASS[33:127] = 5
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in ".,;:!?'\"()-":
    _CLASS[ord(_c)] = 4
_CLASS[0:33] = 0


def index_vectors(items: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sparse ternary vectors: four entries of every item are +1 or -1."""
    rng = np.random.default_rng(7)
    out = np.zeros((items, dimensions), dtype=np.int32)
    rows = np.arange(items)
    for _ in range(4):
        out[rows, rng.integers(0, dimensions, items)] = rng.integers(0, 2, items) * 2 - 1
    return out


def _count(buf: np.ndarray, kind: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_CLASS[buf] == kind, dtype=np.int32)])
    return total[end] - total[start]


def analyse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word items, shape items, offsets of the texts' words, and the rates of every text."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    a, b = word_spans(buf)
    first = np.searchsorted(a, starts)
    n = np.diff(first)
    h = span_hash(buf, a, b)
    size = b - a
    upper, digit, closing, symbol = (_count(buf, k, a, b) for k in (1, 3, 4, 5))
    letters = size - upper - digit - closing - symbol
    case = np.where(upper == 0, 0, np.where(letters == 0, 3, np.where(upper == 1, 1, 2)))
    owner = np.repeat(np.arange(len(texts)), n)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    length = np.minimum(size // 4, 3)
    shape = (((((case * 4 + np.minimum(closing, 3)) * 2 + (digit > 0)) * 4 + np.minimum(symbol, 3)) * 4 + length) * 2 + same).astype(np.int64)
    key = mix64(h ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    distinct = np.zeros(len(texts))
    if len(key):
        order = np.sort(key)
        fresh = np.concatenate([[True], order[1:] != order[:-1]])
        if fresh.all():
            distinct = n.astype(float)
        else:
            by = np.argsort(key, kind="stable")
            distinct = np.bincount(owner[by][fresh], minlength=len(texts)).astype(float)
    per = lambda x: np.bincount(owner, weights=x, minlength=len(texts)) / np.maximum(n, 1)
    chars = np.maximum(np.bincount(owner, weights=size, minlength=len(texts)), 1)
    share = lambda x: np.bincount(owner, weights=x, minlength=len(texts)) / chars
    rates = np.column_stack(
        [np.log1p(n), distinct / np.maximum(n, 1), per(same), per(size), per(size**2) ** 0.5, share(upper), share(digit), share(closing), share(symbol), per(case == 3), per(symbol > 0), per(closing > 1), n == 0]
    )
    return (h % np.uint64(WORDS)).astype(np.int64), WORDS + shape % SHAPES, first, rates


def context_sums(words: np.ndarray, shapes: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For every item, the sum of the index vectors of the items within two words, same text only."""
    out = np.zeros((WORDS + SHAPES, DIMENSIONS), dtype=np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, _CONTEXT + 1):
        near = np.flatnonzero(owner[step:] == owner[:-step])
        for here, there in ((near, near + step), (near + step, near)):
            for a in (words, shapes):
                seen = index[shapes[there]] + index[words[there]]
                order = np.argsort(a[here], kind="stable")
                ids, at = np.unique(a[here][order], return_index=True)
                if len(ids):
                    out[ids] += np.add.reduceat(seen[order], at, axis=0, dtype=np.int64)
    return out


def pooled(words: np.ndarray, shapes: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of every text."""
    out = np.zeros((len(first) - 1, 2 * DIMENSIONS), dtype=np.float64)
    n = np.diff(first)
    some = np.flatnonzero(n > 0)
    if len(some):
        at = first[some]
        for k, items in enumerate((words, shapes)):
            sums = np.add.reduceat(vectors[items], at, axis=0, dtype=np.float64)
            out[some, k * DIMENSIONS : (k + 1) * DIMENSIONS] = sums / n[some, None]
    return out


@dataclass
class Network:
    """Two layers: standardised inputs, tanh units, one logit over a temperature."""

    constant: float | None = None
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    parts: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature minimises the loss on the rest."""
    if not len(y) or y.min() == y.max():
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(11)
    kept = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    rest, use = kept[:cut], kept[cut:]
    net = Network(centre=x[use].mean(0), scale=x[use].std(0) + 1e-6)
    z = np.clip((x[use] - net.centre) / net.scale, -8, 8)
    t = y[use].astype(float)
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) ** 0.5
    weight /= weight.mean()
    net.parts = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = net.parts
        a = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(a @ w2 + b2, -50, 50))) - t) * weight / len(t)
        back = np.outer(error, w2) * (1 - a * a)
        grads = [z.T @ back + decay * w1, back.sum(0), a.T @ error + decay * w2, np.array([error.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit, t = net.logits(x[rest]), y[rest].astype(float)
    losses = [(np.logaddexp(0, logit / k).mean() - (t * logit / k).mean(), k) for k in np.geomspace(0.25, 4, 33)]
    net.temperature = float(min(losses)[1])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[bytes]) -> np.ndarray:
        words, shapes, first, rates = analyse(texts)
        return self.network.probability(np.hstack([pooled(words, shapes, first, self.vectors), rates]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> QualityModel:
    """Fit on at most ``limit`` rows of ``labels`` (doc_id, label) that have a row in ``docs``."""
    marked = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows
    # of rows that share a doc_id the first text in order, so that every fit sees the same
    sample = materialise(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(8, "doc_id"), "training-texts")
    index = index_vectors(WORDS + SHAPES)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS + SHAPES, DIMENSIONS), dtype=np.int64)
        for _, texts in text_batches(batches):
            total += context_sums(*analyse(texts)[:3], index)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([some.astype("<i4").tobytes()]), pa.array([total[some].astype("<i8").tobytes()])], names=["items", "sums"])

    sums = np.zeros((WORDS + SHAPES, DIMENSIONS), dtype=np.int64)
    for row in sample.select("doc_id", "text").mapInArrow(contexts, "items binary, sums binary").toLocalIterator():
        items = np.frombuffer(row["items"], dtype="<i4")
        sums[items] += np.frombuffer(row["sums"], dtype="<i8").reshape(len(items), DIMENSIONS)
    norm = np.sqrt((sums.astype(float) ** 2).sum(1))
    vectors = (sums / np.maximum(norm, 1)[:, None]).astype(np.float32)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            words, shapes, first, rates = analyse(texts)
            x = np.hstack([pooled(words, shapes, first, vectors), rates])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), batch.column(batch.schema.get_field_index("label")).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"],
            )

    rows = sample.select("doc_id", "text", "label").mapInArrow(pool, "doc_id bigint, label int, x array<double>").orderBy("doc_id").toPandas()
    release(sample)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), -1 if len(rows) else 1)
    return QualityModel(vectors, fit_network(x, rows["label"].to_numpy()))


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability of good quality of their whole text added, by default as ``score``."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {name!r} exists")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labelled rows that a fit may use: crc32 of the id as text is not 0 modulo 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
