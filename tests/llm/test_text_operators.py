"""Operators on token ids and media against round trips and brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import bpe, media, sentencepiece, token_scan, token_store
from trialspark.llm.shared import scratch

ODD_TEXTS = [None, "", " ", "a", "  two  spaces ", "x\n\ny\t z", "don't <|endoftext|> é 漢字 \x00", "A" * 5000, "word " * 3000, "ends with space ", "\n lead", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "c", 0.0), (3, "a", "repeat", 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, ids string, n double")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer_path())


@pytest.fixture(scope="module")
def verbatim():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("literally", [False, True])
def test_cached_encoder_equals_the_library(literally, plain, verbatim, spark, sf_dir):
    texts = [t or "" for t in ODD_TEXTS] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect()]
    texts += ["a　b c", "x   y", "tab\t tab", "a \x1c b", "' s 's'", "1 23  4"]
    texts += ["<|endoftext|>", "x<|endoftext|>y <|endoftext|> z", " <|endoftext|><|endoftext|> ", "a " + "b" * 70 + " " + "b" * 70 + "c", "b" * 70 + " " + "b" * 70]
    enc = bpe.CachedEncoder(bpe.default_tokenizer_path(), "<u4", literally)
    for _ in range(2):  # unseen, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode([t.encode() for t in texts])]
        assert got == [(verbatim if literally else plain).encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store(spark, odd, empty, plain):
    out = token_store.read_store(token_store.write_store(odd, bpe.default_tokenizer_path(), scratch(spark, "t"))).orderBy("start").collect()
    assert len(out) == len(ODD_TEXTS) + 2
    assert [r["doc_id"] for r in out] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD_TEXTS))]
    start = 0
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id"}
    for r in out:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = token_store.write_store(empty, bpe.default_tokenizer_path(), scratch(spark, "t"))
    assert token_store.read_store(manifest).count() == 0


def test_repeated_rows_spread_over_shards(spark):
    df = spark.range(400, numPartitions=4).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same").alias("text")).union(spark.createDataFrame([(6, "b"), (8, "a")], "doc_id bigint, text string"))
    manifest = token_store.write_store(df, bpe.default_tokenizer_path(), scratch(spark, "t"))
    assert manifest.count() > 4
    out = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read_store(manifest).orderBy("start").collect()]
    assert [d for d, _, _ in out] == [6, *[7] * 400, 8]
    assert [s for _, s, _ in out] == np.cumsum([0, *[n for _, _, n in out[:-1]]]).tolist()


def test_damaged_shards_are_noticed():
    import zstandard

    sink = io.BytesIO()
    w = token_store.ShardWriter(sink)
    for k in range(3):
        raw = np.arange(k + 1, dtype="<u4").tobytes()
        w.add(k, zstandard.compress(raw), k + 1, zlib.crc32(raw))
    w.close()
    good = sink.getvalue()
    reader = token_store.ShardReader(io.BytesIO(good), len(good))
    assert np.frombuffer(reader.ids(2), "<u4").tolist() == [0, 1, 2]
    assert zstandard.ZstdDecompressor().decompress(good, max_output_size=100)[:4] == b"\0\0\0\0"  # a plain decoder reads the first frame
    bad = bytearray(good)
    bad[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_store.ShardReader(io.BytesIO(bytes(bad)), len(bad))
    with pytest.raises(ValueError, match="not a token shard"):
        token_store.ShardReader(io.BytesIO(good[:-1]), len(good) - 1)


def test_separator_scan(spark, odd, empty, verbatim):
    named = token_scan.write_flat(odd, bpe.default_tokenizer_path(), 50256, scratch(spark, "f"))
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id"}
    want = sorted((-1 if i is None else i, len(verbatim.encode(texts[i] or "", add_special_tokens=False).ids) + 1) for i in [*range(len(ODD_TEXTS)), None, 3])
    for block in (1, 7, 1 << 20):
        blocks = token_scan.scan_files(named.select("path").distinct(), 50256, block)
        got = named.join(token_scan.document_lengths(blocks), ["path", "ordinal"])
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
        assert token_scan.open_tail(blocks).count() == 0
    none = token_scan.write_flat(empty, bpe.default_tokenizer_path(), 50256, scratch(spark, "f"))
    assert token_scan.document_lengths(token_scan.scan_files(none.select("path").distinct(), 50256)).count() == 0


def test_open_tail(spark, tmp_path):
    np.array([1, 9, 2, 3, 9, 4, 4, 4], "<u2").tofile(tmp_path / "x.u16")
    paths = spark.createDataFrame([(str(tmp_path / "x.u16"),)], "path string")
    for block in (1, 2, 3, 100):
        blocks = token_scan.scan_files(paths, 9, block)
        assert sorted(r["n_tokens"] for r in token_scan.document_lengths(blocks).collect()) == [2, 3]
        assert token_scan.open_tail(blocks).first()["n_tokens"] == 3


def best_path(m, word):
    """Viterbi over all substrings, for one word."""
    ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (sentencepiece.NORMAL, sentencepiece.USER_DEFINED)}
    score = {m.pieces[int(i)]: float(m.score[s]) for s, i in enumerate(m.ends) if i >= 0}
    best = [(0.0, None)] + [(-np.inf, None)] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = (best[j - 1][0] + m.unknown_score, None)
        for i in range(max(0, j - 20), j):  # longest first, as ties go
            piece = word[i:j]
            if piece in ids and best[i][0] + score[piece] > best[j][0]:
                best[j] = (best[i][0] + score[piece], i)
    out, j = [], len(word)
    while j:
        i = best[j][1]
        if i is None:
            out += [int(m.byte_ids[b]) for b in reversed(word[j - 1].encode("utf-8"))]
            j -= 1
        else:
            out.append(ids[word[i:j]])
            j = i
    return out[::-1]


def test_sentencepiece_against_brute_force(spark, sf_dir):
    m = sentencepiece.model(sentencepiece.default_model_path())
    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect() for w in r["text"].split(" ")}
    words = ["▁" + w for w in sorted(words)[:800]] + ["▁", "▁▁▁", "▁漢字x", "▁\n\n"]
    for word, got in zip(words, m.encode_words(words), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == best_path(m, word), word


def test_sentencepiece_round_trip(spark, odd, empty):
    path = sentencepiece.default_model_path()
    back = sentencepiece.decode_ids(sentencepiece.encode_texts(odd, path), path)
    assert sorted((r["text"] for r in back.collect())) == sorted([t or "" for t in ODD_TEXTS] + ["no id", "a"])
    assert sentencepiece.encode_texts(empty, path).count() == 0


def png() -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\0\x08\x01\x01\0\0?\0abc\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
WEBP = b"RIFF" + struct.pack("<I", 12) + b"WEBPVP8 " + struct.pack("<I", 0)
ITEMS = {"image/png": png(), "application/gzip": gzip.compress(b"x" * 99, mtime=0), "application/zip": archive(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "image/bmp": BMP, "image/webp": WEBP, "audio/wav": media.wav(b"abc")}


@pytest.mark.parametrize("kind", ITEMS)
def test_sniffs_and_carves(kind):
    item = ITEMS[kind]
    assert media.sniff(item) == (kind, [])
    assert media.sniff(b"some text " + item + b" more") == (media.UNKNOWN, [(10, len(item), kind)])
    assert media.sniff(media.wav(b"...." + item + b"....")) == ("audio/wav", [(48, len(item), kind)])
    assert media.sniff(item[: len(item) // 2])[0] == media.UNKNOWN
    assert media.sniff(item[:4]) == (media.UNKNOWN, [])


def test_media_columns(spark, odd, empty):
    out = media.describe(media.store_texts(odd)).collect()
    assert len(out) == len(ODD_TEXTS) + 2
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id"}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and len(payload) % 192 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
        assert r["actual_type"] == "audio/wav" and r["feature"].startswith("audio/wav;")
    assert media.describe(media.store_texts(empty)).count() == 0
    odd_media = spark.createDataFrame([(1, "image/png", 3, bytearray(b"abc")), (2, "x", 0, None)], "doc_id bigint, declared string, n_bytes bigint, media binary")
    assert [(r["actual_type"], r["payload_bytes"]) for r in media.describe(odd_media).orderBy("doc_id").collect()] == [(media.UNKNOWN, 0)] * 2


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(1, "GIF89a is a signature"), (2, "BMW drives"), (3, "plain"), (4, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: (r["declared_type"], r["actual_type"], r["corrected"]) for r in media.describe(media.store_texts(df)).collect()}
    assert out == {k: (t, "audio/wav", True) for k, t in ((1, "image/gif"), (2, "image/bmp"), (3, "text/plain"), (4, "text/plain"))}


@pytest.mark.parametrize("head", [b"PK\x03\x04", b"GIF89a\x01\0\x01\0\0\0\0,", b"\xff\xd8\xff\xe0\0\x04ab", b"%PDF-1", b"RIFF\xff\0\0\0WAVEfmt "])
def test_many_heads_take_linear_time(head):
    began = time.time()
    assert media.items(head * 60_000) == []
    assert time.time() - began < 10


def test_vocabulary_without_bytes():
    m = sentencepiece.PieceModel([("<unk>", 0.0, sentencepiece.UNKNOWN), ("▁", -1.0, sentencepiece.NORMAL), ("a", -1.0, sentencepiece.NORMAL)])
    assert np.frombuffer(m.encode(["a漢a"])[0], "<i4").tolist() == [1, 2, 0, 2]


def test_equal_texts_equal_features(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same")], "doc_id bigint, text string")
    assert media.describe(media.store_texts(df)).select("feature", "media_sha256").distinct().count() == 1


def test_queries_cover_all_documents(spark, sf_dir):
    from trialspark.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_sentencepiece", "op2_token_store", "op3_media_columns", "op5_token_counts"):
        out = QUERIES[name](spark, sf_dir)
        assert out.agg(F.count("doc_id"), F.count_distinct("doc_id")).first() == (n, n), name
    assert QUERIES["op1_sentencepiece"](spark, sf_dir).where("not decodes").count() == 0
