"""Vectorised word and shingle hashing over batches of UTF-8 texts.

A batch of texts is handled as one flat byte buffer.  Every word gets a 64-bit
hash (polynomial over randomised byte values, computed from one prefix sum for
the whole buffer) and every shingle a mix of the hashes of its words, so the
cost is a few numpy passes whatever the number of texts.  Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; multi-byte characters are compared
byte for byte.
"""

from __future__ import annotations

import numpy as np

_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION_KEYS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EXACT_VALUE = _BYTE_VALUE.copy()
_BYTE_VALUE = _BYTE_VALUE[_LOWER]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes hashed in one go; the power tables have this length, whatever the text.
BLOCK_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base & _MASK64
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        done += k
        step = step * step & _MASK64
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["p"] = _powers(_BASE, BLOCK_BYTES + 1)
        _tables["i"] = _powers(_BASE_INV, BLOCK_BYTES + 1)
    return _tables["p"], _tables["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """Hash of every byte span; spans are sorted and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    power, inverse = _power_tables()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK_BYTES, side="right"))
        if j <= i:  # one span is longer than a block: hash it piece by piece
            acc, at, end = 0, base, int(ends[i])
            while at < end:
                piece = values[buf[at : min(at + BLOCK_BYTES, end)]]
                h = int((piece * power[: len(piece)]).sum(dtype=np.uint64))
                acc = (acc * int(power[BLOCK_BYTES]) * 3 + h) & _MASK64
                at += BLOCK_BYTES
            out[i] = acc
            i += 1
            continue
        last = int(ends[j - 1])
        prefix = np.zeros(last - base + 1, dtype=np.uint64)
        np.cumsum(values[buf[base:last]] * power[: last - base], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (prefix[e] - prefix[s]) * inverse[s]
        i = j
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def piece_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte span, letters in their case."""
    return _span_hash(buf, starts, ends, _EXACT_VALUE)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte buffer."""
    word = np.empty(len(buf) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_IS_SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


class Words:
    """Hashes of the words of a batch of texts, and which text each belongs to."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        self.start, self.end = word_spans(self.buf)
        self.hash = _span_hash(self.buf, self.start, self.end)
        #: words of text i are self.hash[self.first[i]:self.first[i + 1]]
        self.first = np.searchsorted(self.start, self.text_start)


def combine(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words of one flat array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc += words[k : k + n] * _POSITION_KEYS[k]
    return mix64(acc)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short word sequence (fewer words than a shingle)."""
    k = len(words)
    acc = (words * _POSITION_KEYS[32 : 32 + k]).sum(dtype=np.uint64) + np.uint64(k)
    return mix64(np.array([acc], dtype=np.uint64))[0]


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text: flat sorted hashes and offsets.

    The set of text ``i`` is ``flat[off[i]:off[i + 1]]``, ascending.  A text with
    fewer than ``size`` words, but at least one, has its whole sequence as its
    only shingle; a text without words has none.
    """
    w = Words(texts)
    every = combine(w.hash, size)
    sets, off = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            one = np.sort(every[a : b - size + 1])
            keep = np.empty(len(one), dtype=bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            one = one[keep]
        elif b > a:
            one = np.array([sequence_hash(w.hash[a:b])], dtype=np.uint64)
        else:
            one = np.empty(0, dtype=np.uint64)
        sets.append(one)
        off[i + 1] = off[i] + len(one)
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    return flat, off
