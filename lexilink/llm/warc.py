"""WARC files, and the conversion of legacy ARC archives into them.

An ARC file is a run of records: a header line of space-separated fields, a newline, as many bytes as the line's last field declares,
a newline. The first record (`filedesc://`) names the version in its own content, and with it the fields of all later header lines. Each
record is parsed by its declared length and becomes a WARC record with a synthesised id (a name-based UUID of URL, date and digest),
an ISO date made from the 14-digit (or 12-digit) one, a type, and block and payload digests. Payloads that several records share are stored once: the record
with the largest id is the response, the others revisit it.

Each WARC record is a zstandard frame of its own, as in `.warc.zst` files. Spark's own writer commits the files: a row is about `chunk_bytes` of frames, and the
line separator is an empty skippable frame, which readers pass over. A file holds `FILE_CHUNKS` rows, so its size is bounded, and it is read as a stream, record by record.

Edge cases: a null payload is empty; null URLs become `about:blank`; null ids are written as such and never chosen as a response over others; rows that repeat an id
and a payload are one record written again, with one record id and one type; rows that repeat an id with another payload are further records; an ARC record whose declared length passes the end of its file raises; an empty table gives no files. Only
the columns named are read, so further columns may have any name. WARC files of others are read too, plain, gzip or zstandard; what their records don't say is null or computed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import Scratch, arrow_rows, fresh_path, give_back, remove, written

#: Header fields of the two ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_BREAK = b"\r\n\r\n"
#: An empty skippable frame, as the writer's line separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
FILE_CHUNKS = 16


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def _space_free(text: str) -> str:
    """A header field: white space and controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def arc_file(records: list[dict], version: int, name: str = "legacy.arc", date: str = "19960101000000") -> bytes:
    """An ARC file of records with url, ip, date, mime and content (and code, checksum, location)."""
    about = f"{version} 0 LegacyCrawler\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", about, 200, "-", "-", 0, name), about, b"\n"]
    offset = sum(map(len, out))
    for r in records:
        out += [_arc_line(version, r["url"], r.get("ip", "0.0.0.0"), r["date"], r.get("mime", "text/html"), r["content"], r.get("code", 200), r.get("checksum", "-"), r.get("location", "-"), offset, name), r["content"], b"\n"]
        offset += sum(map(len, out[-3:]))
    return b"".join(out)


def _arc_line(version, url, ip, date, mime, content, code, checksum, location, offset, name) -> bytes:
    middle = [] if version == 1 else [str(code), checksum, location, str(offset), name]
    return (" ".join(_space_free(x) for x in [url, ip, date, mime, *middle, str(len(content))]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the file's own description, whose version says which fields a header line has."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length or length < 0:
            raise ValueError(f"record at {at} declares {length} bytes, {len(content)} are left")
        at = end + 1 + length
        if values[0].startswith("filedesc://"):
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        if len(values) < len(names):
            raise ValueError(f"{len(values)} fields in a version {version} header line")
        # URLs of old crawlers may hold spaces: surplus fields belong to the first.
        surplus = len(values) - len(names)
        yield ArcRecord(dict(zip(names, [" ".join(values[: surplus + 1]), *values[surplus + 1 :]], strict=True)), content)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_payload(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload) of an archived response; without a head everything is payload."""
    if content.startswith(b"HTTP/"):
        m = re.search(rb"\r?\n\r?\n", content)
        if m:
            return content[: m.end()], content[m.end() :]
    return b"", content


def iso_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or less, as a WARC date; what is missing is the earliest."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    full = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def synthesise(record: ArcRecord, key: str = "") -> dict:
    """What a WARC record needs beyond the ARC record: id, date, type, digests."""
    head, payload = http_payload(record.content)
    digest = payload_digest(payload)
    url, date = record.fields["URL"], iso_date(record.fields["Archive-date"])
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(ARC_NAMESPACE, f'{url} {date} {digest} {key}')}>",
        "url": url,
        "date": date,
        "type": "response" if head else "resource",
        "mime": record.fields["Content-type"],
        "ip": record.fields["IP-address"],
        "block": record.content,
        "head": head,
        "block_digest": payload_digest(record.content),
        "payload_digest": digest,
        "payload_bytes": len(payload),
    }


def warc_record(r: dict, extra: dict[str, str]) -> bytes:
    """One WARC/1.1 record without the two line breaks after its block."""
    kind = "application/http; msgtype=response" if r["type"] in ("response", "revisit") else r["mime"]
    lines = {
        "WARC-Type": r["type"],
        "WARC-Record-ID": r["record_id"],
        "WARC-Date": r["date"],
        "WARC-Target-URI": r["url"],
        "WARC-IP-Address": r["ip"],
        "WARC-Block-Digest": f"sha1:{r['block_digest']}",
        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
        **extra,
        "Content-Type": kind,
        "Content-Length": str(len(r["block"])),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + r["block"]


def _opened(content: bytes) -> io.BufferedIOBase:
    """A file's records as a stream, whatever it is compressed with."""
    if content[:4] == b"\x28\xb5\x2f\xfd" or content[1:4] == b"*M\x18":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True), 1 << 16)
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths, holding one record at a time."""
    stream = _opened(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers, last = {}, ""
        while (line := stream.readline().rstrip(b"\r\n").decode("utf-8", "replace")) != "":
            if line[0] in " \t" and last:  # a folded line goes on
                headers[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != _BREAK:
            raise ValueError(f"a record doesn't end after {length} bytes")
        yield headers, block


def _dated(page: int | None) -> str:
    """A 14-digit crawl date that follows from the id; null ids share one."""
    return (datetime(1996, 1, 1, tzinfo=UTC) + timedelta(seconds=(page or 0) * 7919 % 788_400_000)).strftime("%Y%m%d%H%M%S")


def archives(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int | None], bytes]]:
    """(ids, archive): rows (page_id, url, html) as legacy archives of many records, one for each batch, of either version in turn."""
    for k, batch in enumerate(batches):
        pages, records = batch.column(0).to_pylist(), []
        for page, url, html in zip(pages, batch.column(1).to_pylist(), batch.column(2), strict=True):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
            records.append({"url": url or "about:blank", "date": _dated(page), "content": content})
        yield pages, arc_file(records, 1 + k % 2)


_TEXTS = ("record_id", "url", "date", "type", "mime", "ip", "block_digest", "payload_digest")
_RECORD_SCHEMA = "page_id long, " + ", ".join(f"{c} string" for c in _TEXTS) + ", block binary, head_bytes long, payload_bytes long"


def _converted(pages: list[int | None], arc: bytes) -> pa.RecordBatch:
    """The WARC side of each record of an archive; pages: their ids in its order."""
    made = [synthesise(r, f"{page}") | {"page_id": page} for page, r in zip(pages, parse_arc(arc), strict=True)]
    columns = {"page_id": pa.array(pages, pa.int64())} | {c: pa.array([m[c] for m in made], pa.string()) for c in _TEXTS}
    columns |= {"block": pa.array([m["block"] for m in made], pa.binary()), "head_bytes": pa.array([len(m["head"]) for m in made], pa.int64()), "payload_bytes": pa.array([m["payload_bytes"] for m in made], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def arc_records(arcs: DataFrame) -> DataFrame:
    """The records of archives, rows (page_ids: one id for each record or null, arc: the archive's bytes)."""

    def run(iterator):
        for batch in iterator:
            for pages, arc in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = arc.as_py()
                pages = [None] * sum(1 for _ in parse_arc(content)) if pages is None else pages
                if pages:
                    yield _converted(pages, content)
        give_back()

    return arcs.select("page_ids", "arc").mapInArrow(run, _RECORD_SCHEMA)


def page_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, archive_bytes: int = 1 << 20) -> DataFrame:
    """The records of the archives that rows of pages make, about archive_bytes each."""

    def run(iterator):
        for pages, arc in archives(wb.batches(iterator, "html", archive_bytes)):
            yield _converted(pages, arc)
        give_back()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, _RECORD_SCHEMA)


def write_warc(records: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = 1 << 20, broadcast_rows: int = 250_000) -> None:
    """WARC files of records: equal payloads of at least least_bytes are stored once, in the record of the largest id.

    Which record that is follows from narrow columns. Payloads that repeat are broadcast while they are at most broadcast_rows, rows of bounded size; beyond that records are shuffled by
    digest, where Spark can split a digest that is frequent.
    """
    spark = records.sparkSession
    with Scratch(spark) as scratch, arrow_rows(spark, 1000):
        records = scratch.written(records, "warc-records")
        # Null ids sort below all others, equal ids by record id.
        light = records.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
        chosen = scratch.written(light.agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "b", "first"), "warc-shared")
        side = F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen
        joined = records.join(side, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left").drop("d", "b")

        def run(iterator):
            compress = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
            held, size = [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array([SEPARATOR.encode().join(held)], pa.binary())], ["chunk"])

            for batch in iterator:
                blocks = batch.column(batch.schema.get_field_index("block"))
                for r, block in zip(batch.drop_columns("block").to_pylist(), blocks, strict=True):
                    frame = compress(_stored(r | {"block": block.as_py()}) + _BREAK)
                    held.append(frame)
                    size += len(frame)
                    if size >= chunk_bytes:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()
            give_back()

        rows = joined.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string"))
        rows.write.mode("error").option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_CHUNKS).option("compression", "none").text(path)


def _stored(r: dict) -> bytes:
    """A record as it is written: as a revisit if another one holds its payload."""
    first = r["first"]
    extra = {"X-Page-ID": "-" if r["page_id"] is None else str(r["page_id"]), "X-Payload-Length": str(r["payload_bytes"])}
    if first and first["record_id"] != r["record_id"]:
        block = r["block"][: r["head_bytes"]]
        r |= {"type": "revisit", "block": block, "block_digest": payload_digest(block)}
        extra |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": first["record_id"],
            "X-Refers-To-Page": "-" if first["page_id"] is None else str(first["page_id"]),
        }
    return warc_record(r, extra)


def _number(text: str | None) -> int | None:
    return int(text) if text not in (None, "-") else None


def _read_back(h: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date of a record; its digests must be right."""
    own, said, size = h.get("warc-block-digest"), h.get("warc-payload-digest", "").removeprefix("sha1:"), _number(h.get("x-payload-length"))
    if own and own.startswith("sha1:") and own != f"sha1:{payload_digest(block)}":
        raise ValueError(f"block digest of {h.get('warc-record-id')}")
    if h.get("warc-type") != "revisit":
        payload = http_payload(block)[1] if h.get("content-type", "").startswith("application/http") else block
        digest = payload_digest(payload)
        if (said and ":" not in said and digest != said) or (size is not None and size != len(payload)):
            raise ValueError(f"payload digest of {h.get('warc-record-id')}")
        said, size = digest, len(payload)
    return _number(h.get("x-page-id")), size, said or None, h.get("warc-type"), _number(h.get("x-refers-to-page")), h.get("warc-target-uri"), h.get("warc-date")


def read_warc(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date of each record of the files; digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0").select("content")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(iterator):
        for batch in iterator:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(content.as_py()):
                    rows.append(_read_back(headers, block))
                    if len(rows) >= 2000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)
        give_back()

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages through ARC archives, the converter and WARC files; what the files say when read back, after which they are deleted."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(page_records(pages, id_col, url_col, html_col), path, least_bytes)
    with arrow_rows(spark, 1):
        out = written(read_warc(spark, path), "warc-read")
    remove(spark, path)
    return out
