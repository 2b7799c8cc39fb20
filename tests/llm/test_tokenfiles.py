import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexilink.llm import tokenfiles as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n", "Hello world's 42nd", "a<|endoftext|>b <|startoftext|> c<|", "É́ é  x y\x1cz", "ΣΑΣ İstanbul ǅ", "日本語テキスト", "tab\there\r\nnew\x0bline",
    "x" * 5000, "the " * 3000, "!!!### a.b,c;d 'S it'll I'D", "﻿bom ​zero　wide", "emoji 👩‍👩‍👧 ok",
    "HELLO!! Hello, hello... <|ENDOFTEXT|> dogs'. it's, It'S; a_b_ x1. ½. Ⅷ, é, E̱! H̱ ŉ, 'n' ͅa. K.", "ªº, ²! ٣. ǆ, ʰ; ́. aͅ! (a) [b], c‍. 中. 中,a",
]


def direct(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_library():
    encoder = tf.Encoder(PATH, 1)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(TEXTS, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(TEXTS, parts, strict=True):
            assert part.tolist() == direct(text), repr(text)[:60]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(tf, "MEMO_WORDS", 3)
    monkeypatch.setattr(tf, "MEMO_CHUNKS", 5)
    encoder = tf.Encoder(PATH, 1)
    for text in TEXTS * 2:
        assert encoder.encode(pa.array([text], pa.string()))[0].tolist() == direct(text)


def test_round_trip(spark, tmp_path):
    rows = [(i * 3 % 16, t, 0) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (5, "again", 0), (5, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = tf.tokenize_round_trip(df, PATH, frame_tokens=50, file_bytes=4000).orderBy("start").collect()
    want, at = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(direct(text), "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert tf.tokenize_round_trip(df.limit(0), PATH).count() == 0


def test_seek_and_damage():
    encoder = tf.Encoder(PATH, 1)
    writer = tf.FrameWriter(encoder.width, 3, 10)
    ids, counts = encoder.encode(pa.array(TEXTS, pa.string()))
    frames = [*writer.add(list(range(len(TEXTS))), counts, ids), *writer.close()]
    content = b"".join(f + tf.SEPARATOR.encode() for f in frames)
    file = tf.SeekableFile.of(content)
    assert [p.tolist() for p in file.get(3)] == [direct(TEXTS[3])] and file.get(99) == []
    start, size = file.frames[1][:2]
    broken = bytearray(content)
    broken[start + size - 6] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        tf.SeekableFile.of(bytes(broken)).frame(1)


def test_every_code_point():
    """Each character alone, inside a word, before and after punctuation, capitals and marks."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0 or 0xAC00 <= c < 0xAD00 or 0xF900 <= c < 0x10000)]
    texts = [f"{c} a{c}b {c}.x ({c}) A{c}'s {c}\u0301 {c}\u0307. 1{c}{c}2 .{c}" for c in chars]
    encoder = tf.Encoder(PATH, 1)
    assert encoder.words is not None
    library = Tokenizer.from_file(PATH)
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        ids, counts = encoder.encode(pa.array(part))
        for text, own, e in zip(part, np.split(ids, np.cumsum(counts)[:-1]), library.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert own.tolist() == [*e.ids, 1], ascii(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tf.Encoder(path, 50256), Tokenizer.from_file(path)
    assert encoder.words is None
    ids, counts = encoder.encode(pa.array(TEXTS, pa.string()))
    for text, own in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 50256]


def test_files_are_ordered_by_their_own_numbers(spark, tmp_path):
    assert tf.file_number("file:/x/part-3/y/part-100000-ab-c000.txt") == 100000
    rows = [(99999, 0, 1, 5, 0, 0), (100000, 0, 2, 7, 0, 0), (100000, 1, 3, 1, 0, 7), (2, 0, 0, 4, 0, 0)]
    read = spark.createDataFrame(rows, "file long, at long, doc_id long, n_tokens long, ids_crc32 long, before long")
    assert {r["doc_id"]: r["start"] for r in tf.token_offsets(read).collect()} == {0: 0, 1: 4, 2: 9, 3: 16}
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    path = f"{tmp_path}/part-3/tokens"
    tf.write_tokens(df, path, PATH, file_bytes=40)
    assert tf.token_offsets(tf.read_tokens(spark, path)).select("start").distinct().count() == 40


def test_single_documents_by_ranges(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    path = f"{tmp_path}/tokens"
    tf.write_tokens(df, path, PATH, frame_tokens=20)
    names = sorted(str(p) for p in (tmp_path / "tokens").iterdir() if p.name.startswith("part-"))
    files = [tf.SeekableFile.open(spark, n) for n in names]
    read = []
    for f in files:
        f.fetch = lambda start, length, own=f.fetch: read.append(length) or own(start, length)
    assert [p.tolist() for f in files for p in f.get(17)] == [direct("text number 17")]
    assert len(read) == 1 and read[0] < 200
