"""Media columns (operator 3): signature sniffing, validation and carving.

One Aho-Corasick automaton over the magic bytes of all formats finds every
candidate position in a single pass over a blob; a validator of the format then
walks the structure that the magic promises and returns the item's length, or
None.  A blob whose item starts at 0 gets that item's type, whatever type was
declared; every valid item further in is carved (type, offset, length), items
within a carved item excepted.

Cases: a null or empty blob is ``application/octet-stream`` without items; a
magic without a valid structure is no item; when two formats match at the same
offset, the longer item wins, then the alphabetically first type.  Null ids and
repeated rows are kept, further columns ignored, an empty table gives no rows.
Very long blobs go through whole: what validators learn about a blob is kept
while it is read, so walks over blocks, and searches for end marks, are done once
however many magics stand before them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.shared import documents_of, materialise, text_batches

UNKNOWN = "application/octet-stream"


class Blob:
    """A blob with what its validators have learnt: where marks stand, and how walks from a position end.

    Validators start at every magic, so the same stretch may be walked many times;
    a walk that reaches a position seen before ends as that one did.
    """

    def __init__(self, data: bytes):
        self.data, self.marks, self.ends = data, {}, {}

    def positions(self, mark: bytes) -> list[int]:
        if mark not in self.marks:
            found, at = [], self.data.find(mark)
            while at >= 0:
                found.append(at)
                at = self.data.find(mark, at + 1)
            self.marks[mark] = found
        return self.marks[mark]

    def find(self, mark: bytes, start: int) -> int:
        found = self.positions(mark)
        k = bisect_left(found, start)
        return found[k] if k < len(found) else -1

    def rfind(self, mark: bytes, stop: int) -> int:
        """Last place of a mark that ends at or before ``stop``."""
        found = self.positions(mark)
        k = bisect_right(found, stop - len(mark))
        return found[k - 1] if k else -1

    def walk(self, name: str, at: int, step: Callable[[bytes, int], tuple[str, int]]) -> int | None:
        """End of a chain of steps, or None; ``step`` gives ("go", next), ("end", end) or ("bad", 0)."""
        known, path = self.ends.setdefault(name, {}), []
        while at not in known:
            path.append(at)
            what, to = step(self.data, at)
            if what == "go" and to > at:
                at = to
                continue
            known[path[-1]] = to if what == "end" else None
            at = path[-1]
        end = known[at]
        for x in path:
            known[x] = end
        return end


def _riff(form: bytes, head: bytes) -> Callable[[Blob, int], int | None]:
    def length(blob: Blob, at: int) -> int | None:
        b = blob.data
        if b[at + 8 : at + 12] != form or b[at + 12 : at + 16] not in (head, b"VP8L", b"VP8X"):
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        pos, data = at + 12, False
        while pos + 8 <= end:  # chunks have to tile the form
            size = struct.unpack_from("<I", b, pos + 4)[0]
            data = data or b[pos : pos + 4] == b"data"
            pos += 8 + size + size % 2
        return end - at if pos == end and (form != b"WAVE" or data) else None

    return length


def _png_step(b: bytes, pos: int) -> tuple[str, int]:
    if pos + 12 > len(b):
        return ("bad", 0)
    size, kind = struct.unpack_from(">I4s", b, pos)
    end = pos + 12 + size
    if end > len(b) or not kind.isalpha() or zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
        return ("bad", 0)
    return ("end", end) if kind == b"IEND" else ("go", end)


def _png(blob: Blob, at: int) -> int | None:
    if blob.data[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None
    end = blob.walk("png", at + 8, _png_step)
    return None if end is None else end - at


def _jpeg_step(b: bytes, pos: int) -> tuple[str, int]:
    if pos + 4 > len(b) or b[pos] != 0xFF or not 0xC0 <= b[pos + 1] <= 0xFE:
        return ("bad", 0)
    size = struct.unpack_from(">H", b, pos + 2)[0]
    if size < 2:
        return ("bad", 0)
    return ("end" if b[pos + 1] == 0xDA else "go", pos + 2 + size)


def _jpeg(blob: Blob, at: int) -> int | None:
    scan = blob.walk("jpeg", at + 2, _jpeg_step)  # entropy-coded data up to the end marker
    end = blob.find(b"\xff\xd9", scan) if scan is not None else -1
    return end + 2 - at if end >= 0 else None


def _gif_step(b: bytes, pos: int) -> tuple[str, int]:
    """One sub-block of a chain, or what follows its end."""
    if pos >= len(b):
        return ("bad", 0)
    if b[pos]:
        return ("go", pos + 1 + b[pos])
    return _gif_block(b, pos + 1)


def _gif_block(b: bytes, pos: int) -> tuple[str, int]:
    if pos >= len(b):
        return ("bad", 0)
    kind = b[pos]
    if kind == 0x3B:
        return ("end", pos + 1)
    if kind == 0x2C and pos + 10 < len(b):
        return ("go", pos + 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0))
    return ("go", pos + 2) if kind == 0x21 else ("bad", 0)


def _gif(blob: Blob, at: int) -> int | None:
    b = blob.data
    if len(b) < at + 13:
        return None
    what, to = _gif_block(b, at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0))
    end = blob.walk("gif", to, _gif_step) if what == "go" else to if what == "end" else None
    return None if end is None else end - at


def _bmp(blob: Blob, at: int) -> int | None:
    b = blob.data
    if len(b) < at + 26:
        return None
    size, reserved, start, head = struct.unpack_from("<IIII", b, at + 2)
    good = head in (12, 40, 52, 56, 64, 108, 124) and not reserved and 14 + head <= start <= size <= len(b) - at
    return size if good else None


def _gzip(blob: Blob, at: int) -> int | None:
    b = blob.data
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    stream = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while rest and not stream.eof:
            stream.decompress(rest, 1 << 20)  # output is checked, not kept
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - at - len(stream.unused_data) if stream.eof else None


def _zip(blob: Blob, at: int) -> int | None:
    """The first end record whose directory starts where it says, seen from this head."""
    b = blob.data
    if "zip" not in blob.ends:
        starts: dict[int, int] = {}
        for end in blob.positions(b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
                if end + 22 + comment <= len(b) and b[end - size : end - size + 4] == b"PK\x01\x02":
                    starts.setdefault(end - size - offset, end + 22 + comment)
        blob.ends["zip"] = starts
    end = blob.ends["zip"].get(at)
    return end - at if end is not None and end > at else None


def _pdf(blob: Blob, at: int) -> int | None:
    b = blob.data
    if not b[at + 5 : at + 6].isdigit():
        return None
    following = blob.find(b"%PDF-", at + 5)
    end = blob.rfind(b"%%EOF", following if following >= 0 else len(b))
    start = blob.find(b"startxref", at)
    return end + 5 - at if end >= at and at <= start <= end - 9 else None


# Magic bytes of the formats, their media types and validators.
FORMATS: list[tuple[bytes, str, Callable[[Blob, int], int | None]]] = [
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"fmt ")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8 ")),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
]

_state: dict[str, object] = {}


def _automaton():
    if "a" not in _state:
        import ahocorasick

        by_magic: dict[str, list[int]] = {}
        for k, (magic, _, _) in enumerate(FORMATS):
            by_magic.setdefault(magic.decode("latin-1"), []).append(k)
        a = ahocorasick.Automaton()
        for magic, kinds in by_magic.items():
            a.add_word(magic, (len(magic), kinds))
        a.make_automaton()
        _state["a"] = a
    return _state["a"]


def items(blob: bytes | None) -> list[tuple[int, int, str]]:
    """Valid items of a blob, outermost only: (offset, length, type), by offset."""
    if not blob:
        return []
    found, known = [], Blob(blob)
    for last, (size, kinds) in _automaton().iter(blob.decode("latin-1")):
        at = last - size + 1
        for k in kinds:
            try:
                length = FORMATS[k][2](known, at)
            except (struct.error, IndexError):
                length = None
            if length:
                found.append((at, -length, FORMATS[k][1]))
    out, inner = [], 0
    for at, minus, kind in sorted(found):
        if not at:
            if not out:
                out.append((at, -minus, kind))
        elif at >= inner:
            out.append((at, -minus, kind))
            inner = at - minus
    return out


def sniff(blob: bytes | None) -> tuple[str, list[tuple[int, int, str]]]:
    """Actual type of a blob and the items embedded in it or after it."""
    all_items = items(blob)
    if all_items and not all_items[0][0]:
        return all_items[0][2], all_items[1:]
    return UNKNOWN, all_items


SAMPLE_RATE = 8000
PAD_TO = 192


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE container; the samples are kept as they are."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples
    body += b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(media: bytes) -> bytes:
    """Samples of a RIFF/WAVE file, found by walking its chunks."""
    pos = 12
    while pos + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, pos)
        if kind == b"data":
            return media[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


PLAIN = "text/plain"


def declared_type(text: bytes) -> str:
    """The type that a text's leading signature claims, valid or not; plain text without one."""
    return next((kind for magic, kind, _ in FORMATS if text.startswith(magic)), PLAIN)


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as media: (doc_id, declared, n_bytes, media), written to the shared folder.

    The declared type is what the text claims to be, so it is wrong for what is
    stored, and reading corrects it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array([declared_type(t) for t in texts]),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([wav(t + b" " * (PAD_TO - len(t) % PAD_TO if len(t) % PAD_TO or not t else 0)) for t in texts], pa.binary()),
                ],
                names=["doc_id", "declared", "n_bytes", "media"],
            )

    return materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, declared string, n_bytes bigint, media binary"), "media")


def feature_of(kind: str, samples: bytes, carved: list[tuple[int, int, str]]) -> str:
    """What a stored item holds, as text: type, length, level statistics and carved items."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256, dtype=np.int64)
    total, square = int(counts @ level), int(counts @ (level * level))
    used = np.flatnonzero(counts)
    low, high = (int(used[0]), int(used[-1])) if len(used) else (0, 0)
    head = f"{kind};rate={SAMPLE_RATE};samples={len(x)};sum={total};energy={square};min={low};max={high};levels={len(used)}"
    return head + ";carved=" + "|".join(f"{k}@{at}+{n}" for at, n, k in carved)


def describe(media: DataFrame) -> DataFrame:
    """Sniff, validate and measure stored media (columns as ``store_texts`` gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, declared, n_bytes, blobs = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "declared", "n_bytes", "media"))
            rows = []
            for blob in blobs:
                blob = blob.as_py() or b""
                kind, carved = sniff(blob)
                samples = wav_samples(blob) if kind == "audio/wav" else b""
                rows.append(
                    (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(kind, samples, carved), kind)
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(
                [ids, n_bytes, *arrays, declared, pc.fill_null(pc.not_equal(declared, arrays[-1]), True)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "actual_type", "declared_type", "corrected"],
            )

    return media.mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, actual_type string, declared_type string, corrected boolean",
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store_texts(documents_of(spark, sf_dir)))
