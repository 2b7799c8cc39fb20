"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with the documents of about `frame_tokens` ids and a content checksum, then an
index and a seek table, both in skippable frames that a plain zstandard reader passes over. The seek table is the usual one: per frame
compressed size, size and checksum, then the number of frames, a flag byte and the magic number. The index adds, per frame, its first and last
document id and its numbers of documents and ids, so a reader fetches and decompresses just the frames of the documents it wants.

Spark's own writer commits the files: a row is a frame, and the line separator is an empty skippable frame (8 bytes). So tasks of lost executors leave nothing
behind, any file system that Spark knows will do, and each file ends with one empty skippable frame after its seek table.

Frame content, little-endian: uint32 documents, uint8 bytes per id (2 or 4), int64 document ids, uint8 id is not null, uint32 ids per
document, ids.

Files and frames are in ascending document id; equal ids are ordered by text, null ids come first. A null or empty text has just the end id. A table without rows
gives no frames.

Encoding: where a tokenizer drops white space and treats what stands between as independent (`Encoder` compares its normalizer and pre-tokenizer
with those it knows), a text's ids are those of its chunks between ASCII white space, one after another, and equal chunks are encoded once. Chunks of printable
ASCII and plain letters are lower-cased and cut into words here, as the tokenizer itself would, and the library's model encodes each word once; the library
encodes all other chunks from the start. Texts of any other tokenizer go to the library whole. Up to `MEMO_CHUNKS` chunks and
`MEMO_WORDS` words are remembered per worker.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import arrow_rows, fresh_path, give_back, remove, written

#: An empty skippable frame, as the writer's line separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
INDEX_MAGIC, SEEK_FRAME_MAGIC, SEEK_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
_ENTRY = struct.Struct("<qqBBII")
MEMO_CHUNKS, MEMO_WORDS = 1_000_000, 250_000
#: The normalizer and the pre-tokenizer whose words are known without the library.
_KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters below it are looked at one by one; none of them combine with each other.
_LETTERS_TO = 0x530


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all runs, one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, the next from 256 on otherwise."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Words:
    """Words of plain chunks and their byte-level spelling, as the known normalizer and pre-tokenizer make them."""

    def __init__(self, tokenizer):
        small, letters = {}, []
        for c in map(chr, range(0x80, _LETTERS_TO)):
            if unicodedata.category(c)[0] != "L":
                continue
            low = tokenizer.normalizer.normalize_str(f"a{c}")[1:]
            alike = all(tokenizer.normalizer.normalize_str(f"{x}{c}{y}") == f"{x}{low}{y}" for x, y in (("", ""), ("a", "b"), (".", ".")))
            if alike and len(low) == 1 and len(tokenizer.pre_tokenizer.pre_tokenize_str(f"a{low}b")) == 1:
                small[ord(c)] = low
                letters.append(c)
        lowered = "".join(dict.fromkeys(small.values()))
        self.small = str.maketrans({chr(k): v for k, v in small.items()} | {chr(k): chr(k + 32) for k in range(65, 91)})
        self.plain = re.compile(f"[!-~{''.join(letters)}]*").fullmatch
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{lowered}]+|[0-9]|[^a-z0-9{lowered}]+").findall
        spelt = _byte_letters()
        self.spelling = str.maketrans({c: "".join(spelt[b] for b in c.encode()) for c in lowered})

    def of(self, chunk: str) -> list[str] | None:
        """The words of a chunk; None if the library has to say."""
        if not self.plain(chunk) or "<|" in chunk:
            return None
        return self.find(chunk.lower() if chunk.isascii() else chunk.translate(self.small))


class Encoder:
    """Ids of whole texts with an end id."""

    _kept: dict = {}

    @classmethod
    def at(cls, path: str, end: int) -> Encoder:
        if (path, end) not in cls._kept:
            cls._kept[path, end] = cls(path, end)
        return cls._kept[path, end]

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.end = end
        self.words = _Words(self.tokenizer) if self._known() else None
        self._forget()
        self._forget_words()

    def _known(self) -> bool:
        j = json.loads(self.tokenizer.to_str())
        steps = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split, rest = steps[0], steps[1:]
        return (
            (j.get("normalizer") or {}).get("normalizers") == _KNOWN_NORMALIZER
            and split.get("type") == "Split"
            and split.get("pattern") == {"Regex": _KNOWN_SPLIT}
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and [(s["type"], s["add_prefix_space"], s["use_regex"]) for s in rest] == [("ByteLevel", False, False)]
            and j["truncation"] is None
            and j["padding"] is None
            and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in j["added_tokens"])
        )

    def _forget(self) -> None:
        """Known chunks by ascending hash, a second hash of each, and the place of their ids."""
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _forget_words(self) -> None:
        self.number: dict[str, int] = {}
        self.word_start, self.word_length, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn_words(self, words: list[str]) -> None:
        tokenize, spelling = self.tokenizer.model.tokenize, self.words.spelling
        ids = [[t.id for t in tokenize(w if w.isascii() else w.translate(spelling))] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.word_start = np.concatenate([self.word_start, len(self.word_ids) + np.cumsum(lengths) - lengths])
        self.word_length = np.concatenate([self.word_length, lengths])
        self.word_ids = np.concatenate([self.word_ids, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each)."""
        split = [self.words.of(c) for c in chunks]
        if len(self.number) > MEMO_WORDS:
            self._forget_words()
        unknown = dict.fromkeys(w for words in split if words for w in words if w not in self.number)
        if unknown:
            self._learn_words(list(unknown))
        odd = [k for k, words in enumerate(split) if words is None]
        by_library = dict(zip(odd, (e.ids for e in self.tokenizer.encode_batch_fast([chunks[k] for k in odd], add_special_tokens=False)), strict=True))
        # What the library said goes behind the words' ids.
        extra = np.fromiter((i for x in by_library.values() for i in x), np.uint32)
        lengths = np.fromiter(map(len, by_library.values()), np.int64, len(by_library))
        values = np.concatenate([self.word_ids, extra])
        starts = np.concatenate([self.word_start, len(self.word_ids) + np.cumsum(lengths) - lengths])
        lengths = np.concatenate([self.word_length, lengths])
        place = {k: len(self.number) + i for i, k in enumerate(odd)}
        look = self.number.__getitem__
        of = np.fromiter((i for k, words in enumerate(split) for i in (map(look, words) if words is not None else (place[k],))), np.int64)
        parts = np.fromiter((1 if words is None else len(words) for words in split), np.int64, len(split))
        total = np.concatenate([[0], np.cumsum(lengths[of])])
        ends = np.cumsum(parts)
        return _gather(values, starts[of], lengths[of]), total[ends] - total[ends - parts]

    def _find(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks in the memo, which learns those that it hasn't."""
        data, offsets = wb.text_bytes(chunks)
        h, check = (wb.spans_hash(data, offsets[:-1], offsets[1:], exact_case=e) for e in (True, False))

        def look() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
            return at, (self.hash[at] == h) & (self.check[at] == check) if len(self.hash) else np.zeros(len(h), bool)

        at, known = look()
        if known.all():
            return at
        if len(self.hash) > MEMO_CHUNKS:
            self._forget()
            known[:] = False
        new = np.flatnonzero(~known)
        ids, lengths = self._encode_chunks(chunks.take(pa.array(new)).to_pylist())
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        merged = [np.concatenate([a, b]) for a, b in ((self.hash, h[new]), (self.check, check[new]), (self.start, starts), (self.length, lengths))]
        order = np.argsort(merged[0], kind="stable")
        self.hash, self.check, self.start, self.length = (m[order] for m in merged)
        at, known = look()
        if not known.all():
            raise ValueError("two chunks have one hash")
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.words is None:
            found = [[*e.ids, self.end] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        at = self._find(coded.dictionary)
        codes = np.asarray(coded.indices)
        starts, lengths = self.start[at][codes], self.length[at][codes]
        # Each text's chunks, then its end id, which stands behind all others.
        texts_end = bounds[1:] - bounds[0]
        starts, lengths = np.insert(starts, texts_end, len(self.ids)), np.insert(lengths, texts_end, 1)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], texts_end + np.arange(1, len(texts) + 1)])]
        return _gather(np.append(self.ids, np.uint32(self.end)), starts, lengths), np.diff(ends)


def pack_frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    head = struct.pack("<IB", len(doc_ids), width)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()])


def unpack_frame(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids as little-endian uint32)."""
    n, width = struct.unpack_from("<IB", content)
    docs = np.frombuffer(content, "<i8", n, 5)
    known = np.frombuffer(content, np.uint8, n, 5 + 8 * n)
    counts = np.frombuffer(content, "<u4", n, 5 + 9 * n)
    ids = np.frombuffer(content, f"<u{width}", int(counts.sum()), 5 + 13 * n)
    return [int(d) if k else None for d, k in zip(docs, known, strict=True)], counts.astype(np.int64), ids.astype("<u4")


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Frames of one file, then its index and its seek table."""

    def __init__(self, width: int, level: int, frame_tokens: int):
        self.width, self.frame_tokens = width, frame_tokens
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.docs, self.counts, self.parts, self.held = [], [], [], 0
        self.seek, self.index = [], []

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray):
        """Frames that are full after these documents."""
        at = 0
        for doc, count in zip(doc_ids, counts.tolist(), strict=True):
            self.docs.append(doc)
            self.counts.append(count)
            self.parts.append(ids[at : at + count])
            at += count
            self.held += count
            if self.held >= self.frame_tokens:
                yield self._frame()

    def _frame(self) -> bytes:
        content = pack_frame(self.docs, np.array(self.counts), np.concatenate(self.parts), self.width)
        frame = self.compress(content)
        self.seek.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        # The separator after each frame is an entry of its own, of no content.
        self.seek.append(struct.pack("<III", len(SEPARATOR), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        first, last = self.docs[0], self.docs[-1]
        self.index.append(_ENTRY.pack(first or 0, last or 0, first is not None, last is not None, len(self.docs), self.held))
        self.docs, self.counts, self.parts, self.held = [], [], [], 0
        return frame

    def close(self):
        if self.docs:
            yield self._frame()
        if self.seek:
            yield _skippable(INDEX_MAGIC, b"".join(self.index)) + _skippable(SEEK_FRAME_MAGIC, b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC))


class SeekableFile:
    """Reads single documents of a file through its index. `fetch(start, length)` reads a range: of a file of `size` bytes only its tables and the frames asked for are read."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self.fetch = fetch
        end = size - len(SEPARATOR)
        frames, flags, magic = struct.unpack("<IBI", fetch(end - 9, 9))
        if magic != SEEK_MAGIC or flags & 0x80 == 0:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(fetch(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)[:-1]])
        self.frames = [(int(s), *map(int, row)) for s, row in zip(starts, table, strict=True) if row[1]]
        length = _ENTRY.size * len(self.frames)
        self.index = list(_ENTRY.iter_unpack(fetch(end - 9 - 12 * frames - 8 - length, length)))

    @classmethod
    def of(cls, content: bytes) -> SeekableFile:
        return cls(lambda start, length: content[start : start + length], len(content))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SeekableFile:
        """A file in any file system that Spark knows, read by ranges from here."""
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = fs.open(p)

        def fetch(start: int, length: int) -> bytes:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))

        return cls(fetch, fs.getFileStatus(p).getLen())

    def frame(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        start, packed, size, checksum = self.frames[k]
        content = zstandard.ZstdDecompressor().decompress(self.fetch(start, packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return unpack_frame(content)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of this id; only frames that may hold it are decompressed."""
        out = []
        for k, (first, last, has_first, has_last, _, _) in enumerate(self.index):
            if has_last and last >= doc_id and (not has_first or first <= doc_id):
                docs, counts, ids = self.frame(k)
                parts = np.split(ids, np.cumsum(counts)[:-1])
                out += [p for d, p in zip(docs, parts, strict=True) if d == doc_id]
        return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", frame_tokens: int = 1 << 17, file_bytes: int = 16 << 20, level: int = 3
) -> None:
    """Token files of all documents in ascending id, each from about file_bytes of text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = plain.repartitionByRange(-(-total // file_bytes) + 1, "doc").sortWithinPartitions("doc", "text")

    def run(iterator):
        encoder = Encoder.at(tokenizer_path, end_id)
        writer = FrameWriter(encoder.width, level, frame_tokens)
        for batch in wb.batches(iterator, "text"):
            ids, counts = encoder.encode(batch.column(1))
            for frame in writer.add(batch.column(0).to_pylist(), counts, ids):
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])
        for frame in writer.close():
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])
        give_back()

    frames = ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))
    with arrow_rows(docs.sparkSession, 1000):
        frames.write.mode("error").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def file_number(name: str) -> int:
    """The number in a part file's own name, whatever the folders above it are called."""
    return int(re.match(r"part-(\d+)", name.rsplit("/", 1)[-1])[1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file (its number), at (place in the file), doc_id, n_tokens, ids_crc32, before (ids before it in the file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 8").select("path", "content")

    def run(iterator):
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, file = file_number(name), SeekableFile.of(content.as_py())
                place = before = 0
                for k in range(len(file.frames)):
                    docs, counts, ids = file.frame(k)
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number)), pa.array(np.arange(place, place + n)), pa.array(docs, pa.int64()), pa.array(counts), pa.array(crc, pa.int64()), pa.array(before + ends - counts)],
                        ["file", "at", "doc_id", "n_tokens", "ids_crc32", "before"],
                    )
                    place, before = place + n, before + int(ends[-1])
        give_back()

    return files.mapInArrow(run, "file long, at long, doc_id long, n_tokens long, ids_crc32 long, before long")


def token_offsets(rows: DataFrame, block: int = 1000) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 over all files by number: sums of files within blocks of `block`, then of blocks, so one task sees one row per block."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("file") / block))

    def before(*by: str) -> Window:
        return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)

    of_blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    base = of_blocks.select("block", F.coalesce(F.sum("n").over(before().orderBy("block")), F.lit(0)).alias("base"))
    within = totals.select("file", "block", F.coalesce(F.sum("n").over(before("block").orderBy("file")), F.lit(0)).alias("inner"))
    starts = within.join(base, "block").select("file", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, **options) -> DataFrame:
    """What the written files say when they are read back; they are deleted after that."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    with arrow_rows(spark, 1):
        rows = written(read_tokens(spark, path), "token-rows")
    remove(spark, path)
    return token_offsets(rows)
