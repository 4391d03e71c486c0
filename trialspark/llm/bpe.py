"""Byte-level BPE of whole texts with the tokenizers library, remembering words.

A single space between two characters that are not white space always starts a
new pre-token of the byte-level pattern, so a text may be cut there and the ids
of the pieces joined.  The pieces of a batch are found and hashed as arrays, only
distinct ones are looked up, and a worker keeps the ids of the pieces it has seen
in a bounded cache, so the tokenizer runs on unseen pieces alone.

Pieces of up to ``EXACT_BYTES`` bytes are told apart by 64-bit hashes of their
bytes and lengths: a full cache holds two that agree by chance with a probability
of about 1 in 10^8, and no bytes are compared.  Longer pieces
are told apart by their bytes.

By default special tokens in a text are what the library makes of them with
``add_special_tokens=False``: ``<|endoftext|>`` is its one id.  A ``verbatim``
encoder treats them as plain text, for formats in which such an id has a meaning
of its own.
"""

from __future__ import annotations

import os

import numpy as np

from trialspark.llm.hashing import mix64, piece_hashes

#: Pieces remembered by a worker; beyond this number only those of the current batch stay.
CACHE_PIECES = 550_000
#: Unseen pieces that are encoded as one line.
PER_CALL = 200
EXACT_BYTES = 64
_FIRST = np.uint64(0x5851F42D4C957F2D)  # tells a piece at the start of a text from one after a space


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_positions(buf: np.ndarray) -> np.ndarray:
    """Places of the spaces at which a text may be cut.

    White space on either side forbids it.  Beyond ASCII, white space starts with
    one of four bytes; next to a character that starts with one of these there is
    no cut either, which is safe.
    """
    at = np.flatnonzero(buf == 32)
    at = at[(at > 2) & (at < len(buf) - 1)]
    before, after = buf[at - 1], buf[at + 1]
    odd = np.zeros(256, dtype=bool)
    odd[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    wide = before >= 0x80
    bad = (before <= 32) | (after <= 32) | odd[after] | (wide & (odd[buf[at - 2]] | odd[buf[at - 3]]))
    return at[~bad]


class CachedEncoder:
    def __init__(self, path: str, dtype: str, verbatim: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = verbatim
        self.dtype = np.dtype(dtype)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.begins = np.zeros(size, dtype=bool)  # ids of tokens that start with a space
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[i] = token.startswith("Ġ")
        self.named = 0  # long pieces named so far
        self._clear()

    def _clear(self) -> None:
        self.long: dict[bytes, int] = {}  # long pieces: their names
        # remembered pieces by ascending name, and where their ids stand in the pool
        self.name, self.start, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 12, dtype=self.dtype)
        self.used = 0

    def _places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of names among those remembered, and whether they are."""
        if not len(self.name):
            return np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        at = np.minimum(np.searchsorted(self.name, names), len(self.name) - 1)
        return at, self.name[at] == names

    def _remember(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add pieces whose ids stand one after the other in ``ids``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        order = np.argsort(names)
        at = np.searchsorted(self.name, names[order])
        self.name, self.start, self.count = (np.insert(x, at, y[order]) for x, y in ((self.name, names), (self.start, start), (self.count, counts)))

    def _learn(self, names: np.ndarray, pieces: list[str]) -> None:
        """Encode unseen pieces: those of a space and no more spaces in lines, cut where a token starts with a space."""
        plain = [k for k, p in enumerate(pieces) if p[:1] == " " and " " not in p[1:]]
        rest = [k for k, p in enumerate(pieces) if p[:1] != " " or " " in p[1:]]
        lines = [plain[at : at + PER_CALL] for at in range(0, len(plain), PER_CALL)]
        order, ids, counts = [], [], []
        for some, e in zip(lines, self.tokenizer.encode_batch_fast(["".join([pieces[k] for k in some]) for some in lines], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.begins[found])
            if len(cuts) == len(some) and not cuts[0]:
                order += some
                ids.append(found)
                counts.append(np.diff(np.append(cuts, len(found))))
            else:
                rest += some
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            order.append(k)
            ids.append(np.array(e.ids, dtype=self.dtype))
            counts.append(np.array([len(e.ids)]))
        self._remember(names[order], np.concatenate(ids), np.concatenate(counts))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text (UTF-8) as packed integers."""
        buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)  # no cut next to the line ends between texts
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        cuts = cut_positions(buf)
        start, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([begin + sizes, cuts]))
        unit = np.searchsorted(start, begin)
        # a piece after a cut starts with its space; equal starts cannot be: a cut is inside a text
        key = piece_hashes(buf, start, end)
        key[unit] = mix64(key[unit] ^ _FIRST)
        for k in np.flatnonzero(end - start > EXACT_BYTES):
            piece = buf[start[k] : end[k]].tobytes()  # one after a cut starts with its space
            if piece not in self.long:
                self.named += 1
                self.long[piece] = int(mix64(np.array([self.named], dtype=np.uint64))[0])
            key[k] = self.long[piece]
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.name) + len(distinct) > CACHE_PIECES:
            self._keep(distinct)
        _, seen = self._places(distinct)
        if not seen.all():
            missing = np.flatnonzero(~seen)
            at = first[missing]
            raw = buf.tobytes()
            self._learn(distinct[missing], [raw[a:b].decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        slots = self._places(distinct)[0][back]
        counts = self.count[slots]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.pool[np.repeat(self.start[slots] - (stops - counts), counts) + np.arange(total)]
        edges = np.append((stops - counts)[unit], total).tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]

    def _keep(self, names: np.ndarray) -> None:
        """Forget all pieces but the given ones."""
        at, seen = self._places(names)
        at, held = at[seen], names[seen]
        start, counts, pool = self.start[at], self.count[at], self.pool
        self._clear()
        if len(held):
            stops = np.cumsum(counts)
            self._remember(held, pool[np.repeat(start - (stops - counts), counts) + np.arange(int(stops[-1]))], counts)


_encoders: dict[tuple[str, str, bool], CachedEncoder] = {}


def encoder(path: str, dtype: str, verbatim: bool = False) -> CachedEncoder:
    key = (path, dtype, verbatim)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(*key)
    return _encoders[key]
