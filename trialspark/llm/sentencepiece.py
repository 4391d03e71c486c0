"""SentencePiece encoding and decoding (operator 1).

A vocabulary file gives pieces with scores.  An Aho-Corasick automaton over the
pieces reads a text once; at every position the output links name all pieces
that end there, and each relaxes the best score up to that position (Viterbi).

White space never stands inside a piece of a vocabulary with word-initial
markers, so the best path of a text is that of its words in turn.  The words of
a batch are therefore encoded together: distinct words are laid out as a matrix
and one step of the automaton, its output links included, advances all of them
by one character.  What the step costs is shared by all words of the batch.

Characters outside the vocabulary fall back to byte pieces, or to the unknown
piece where the vocabulary has none.  Ties go to the longer last piece.  Cases: a
null or empty text has no ids; repeated spaces are kept; ids decode to the text
again, but for a marker character (U+2581) of the text itself, which decodes to a
space, and for unknown pieces.  Null ids, repeated rows and very long texts are
encoded like others, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.shared import documents_of, text_batches

MARK = "▁"
#: Taken off the lowest score for a character that no piece covers, as the format's own encoder does.
UNKNOWN_PENALTY = 10.0
# Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol buffer message: (number, wire type, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire == 2:
            size = varint()
            yield number, wire, raw[at : at + size]
            at += size
        else:
            size = 4 if wire == 5 else 8
            yield number, wire, raw[at : at + size]
            at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """Pieces of a vocabulary file: (text, score, kind)."""
    pieces = []
    with open(path, "rb") as f:
        for number, _, value in _fields(f.read()):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        text = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((text, score, kind))
    return pieces


class PieceModel:
    """Aho-Corasick automaton over pieces, as arrays that numpy steps for many words at once."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        usable = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED) and p]
        letters = sorted({c for _, p, _ in usable for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)  # code point -> column, 0: in no piece
        for column, c in enumerate(letters, 1):
            self.letter[ord(c)] = column
        children: list[dict[int, int]] = [{}]
        ends, depth = [-1], [0]
        for i, piece, _ in usable:
            state = 0
            for c in piece:
                column = int(self.letter[ord(c)])
                if column not in children[state]:
                    children[state][column] = len(children)
                    children.append({})
                    ends.append(-1)
                    depth.append(depth[state] + 1)
                state = children[state][column]
            ends[state] = i
        n = len(children)
        fail, output = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        queue = deque(children[0].values())
        while queue:
            state = queue.popleft()
            output[state] = state if ends[state] >= 0 else output[fail[state]]
            for column, child in children[state].items():
                back = int(fail[state])
                while back and column not in children[back]:
                    back = int(fail[back])
                fail[child] = children[back].get(column, 0) if back or column in children[0] and children[0][column] != child else 0
                queue.append(child)
        #: next state that ends a piece: the state itself or along suffixes; 0 is none
        self.output = output
        self.fail = fail
        self.next_output = np.where(np.array(ends) >= 0, output[fail], 0).astype(np.int32)
        self.ends = np.array(ends, dtype=np.int32)
        self.depth = np.array(depth, dtype=np.int32)
        score = np.zeros(n)
        by_id = {i: s for i, _, s in usable}
        for state, i in enumerate(ends):
            if i >= 0:
                score[state] = by_id[i]
        self.score = score
        self.unknown_score = min(by_id.values(), default=0.0) - UNKNOWN_PENALTY
        # edges as a sorted array of (state, column) keys; missing edges follow the failure links
        self.width = len(letters) + 1
        keys = [(s * self.width + c, t) for s, kids in enumerate(children) for c, t in kids.items()]
        keys.sort()
        self.edge_key = np.array([k for k, _ in keys], dtype=np.int64)
        self.edge_to = np.array([t for _, t in keys], dtype=np.int32)
        self.root = np.zeros(self.width, dtype=np.int32)
        for column, child in children[0].items():
            self.root[column] = child

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Next states of many automata at once."""
        out = self.root[column]
        todo = np.flatnonzero(state > 0)
        at = state[todo]
        while len(todo):
            key = at.astype(np.int64) * self.width + column[todo]
            slot = np.searchsorted(self.edge_key, key)
            slot[slot == len(self.edge_key)] = 0
            hit = self.edge_key[slot] == key
            out[todo[hit]] = self.edge_to[slot[hit]]
            at = self.fail[at[~hit]]
            todo = todo[~hit]
            alive = at > 0
            todo, at = todo[alive], at[alive]
        return out

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best last state and its length at every position of words of one length (a row of code points each)."""
        words, size = points.shape
        best = np.full((size + 1, words), -np.inf)
        best[0] = 0.0
        back = np.zeros((size + 1, words), dtype=np.int32)  # state of the last piece, 0: unknown character
        length = np.ones((size + 1, words), dtype=np.int32)
        columns = self.letter[points]
        state = np.zeros(words, dtype=np.int32)
        everyone = np.arange(words)
        for i in range(1, size + 1):
            state = self.step(state, columns[:, i - 1])
            best[i] = best[i - 1] + self.unknown_score
            who, out = everyone, self.output[state]
            while True:  # all pieces that end here, longest first
                some = out > 0
                if not some.all():
                    who, out = who[some], out[some]
                if not len(who):
                    break
                d = self.depth[out]
                value = best[i - d, who] + self.score[out]
                better = value > best[i, who]
                w = who[better]
                best[i, w], back[i, w], length[i, w] = value[better], out[better], d[better]
                out = self.next_output[out]
        return back, length

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word as packed 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, every in by_size.items():
            step = max(1, (1 << 20) // max(size, 1))
            for at in range(0, len(every), step) if size else ():
                group = every[at : at + step]
                points = np.frombuffer("".join([words[k] for k in group]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(group), size)
                back, length = self._viterbi(points)
                # walk all words back together; pieces come last first
                pos = np.full(len(group), size)
                who = np.arange(len(group))
                owners, ids = [], []
                while len(who):
                    state, d = back[pos[who], who], length[pos[who], who]
                    known = state > 0
                    if known.all():
                        owners.append(who)
                        ids.append(self.ends[state])
                    else:
                        chunk = self.ends[state].astype(np.int64)
                        for j in np.flatnonzero(~known):
                            c = int(points[who[j], pos[who[j]] - 1])
                            raw = chr(c).encode("utf-8", "surrogatepass")
                            if self.byte_ids[list(raw)].min() < 0:
                                chunk[j] = self.unknown
                                continue
                            for b in raw[:0:-1]:
                                owners.append(who[j : j + 1])
                                ids.append(self.byte_ids[b : b + 1])
                            chunk[j] = self.byte_ids[raw[0]]
                        owners.append(who)
                        ids.append(chunk)
                    pos[who] -= d
                    who = who[pos[who] > 0]
                flat_owner = np.concatenate(owners)[::-1]
                flat_ids = np.concatenate(ids)[::-1].astype("<i4")
                order = np.argsort(flat_owner, kind="stable")
                raw = flat_ids[order].tobytes()
                stops = np.cumsum(np.bincount(flat_owner, minlength=len(group))) * 4
                last = 0
                for k, stop in zip(group, stops.tolist(), strict=True):
                    out[k] = raw[last:stop]
                    last = stop
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as packed 32-bit integers; a marker stands for every space and before the text."""
        cut = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({w for words in cut for w in words}.difference(self._cache()))
        cache = self._cache(len(new))
        todo = [w for w in new if w not in cache] if cache else list({w for words in cut for w in words})
        cache.update(zip(todo, self.encode_words(todo), strict=True))
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _cache(self, coming: int = 0) -> dict[str, bytes]:
        known = self.__dict__.setdefault("_known", {})
        if len(known) + coming > CACHE_WORDS:
            known.clear()
        return known

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids: byte pieces as they are, markers as spaces, the one before the text goes."""
        parts = self.__dict__.setdefault("_bytes", None)
        if parts is None:
            parts = [
                bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode("utf-8")
                for p, k in zip(self.pieces, self.kinds, strict=True)
            ]
            self._bytes = parts
        text = b"".join(map(parts.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


#: A run of markers and what follows, up to the next marker: no piece crosses these.
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Words remembered by a worker; the cache starts anew beyond this number.
CACHE_WORDS = 800_000

_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        pieces = read_pieces(path)
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("pieces with inner spaces need whole texts as words")
        _models[path] = PieceModel(pieces)
    return _models[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every text: (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, texts in text_batches(batches):
            rows = [np.frombuffer(r, dtype="<i4") for r in m.encode([t.decode("utf-8") for t in texts])]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.concatenate(rows) if rows else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of id sequences: (doc_id, text); a null sequence gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if ids is None else m.decode(np.asarray(ids, dtype=np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Number of ids of every text, their crc32, and whether they decode to the text again."""
    path = model_path or default_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, raw in text_batches(batches):
            texts = [t.decode("utf-8") for t in raw]
            rows = m.encode(texts)
            whole = [m.decode(np.frombuffer(r, dtype="<i4")) == t.replace(MARK, " ") for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array([len(r) // 4 for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                    pa.array(whole),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "decodes"],
            )

    return documents_of(spark, sf_dir).mapInArrow(run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decodes boolean")
