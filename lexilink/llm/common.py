"""Shared helpers: table access, tables written in the shared folder, ASCII lower-casing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the licence and benchmark operators: what stands between ASCII characters other than digits and small letters.
ALNUM_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same gaps, character by character: Java's patterns look such a class up in one table, ranges one after another.
_GAP_TABLE = "[" + "".join(f"\\x{c:02X}" for c in range(0x80) if not chr(c).isdigit() and not 0x61 <= c <= 0x7A) + "]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one is made only where that is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexilink-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    # A task holds one row group when it writes and when it reads, so these are small: long texts and sets of hashes stand in them.
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)
    # Where nobody removes it before, it goes when the driver's JVM ends.
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor costs no recomputation."""
    return _write(df, fresh_path(df.sparkSession, what))


class Scratch:
    """Written tables that go when the block ends; what is returned from it must have been written outside, or read none of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh_path(self.spark, what)
        out = _write(df, path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """What no later plan reads goes at once."""
        remove(self.spark, *(self.paths.pop(id(t))[0] for t in tables))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, *(path for path, _ in self.paths.values()))


def beside(table: DataFrame, width: Column, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """A written table as the small side of a join: broadcast if it has at most so many rows and bytes (`width` a row), else as it is, for a join that shuffles."""
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return F.broadcast(table) if found["n"] <= rows and found["size"] <= size else table


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def free_name(base: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    name, n = f"_{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{base}_{n}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does just that for ASCII texts, at a fraction of translate()'s price."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """The words of a text, lower-cased; none for null."""
    gapped = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP_TABLE, -1)
    return F.array_remove(gapped, "")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int, size: int = 1 << 20):
    """While plans of wide rows run, Arrow batches hold at most `most` rows and about `size` bytes; the session's settings are put back."""
    rows, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, limit)}
    spark.conf.set(rows, str(min(most, int(before[rows])) if int(before[rows]) > 0 else most))
    spark.conf.set(limit, str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def give_back() -> None:
    """Returns freed memory of a reused Python worker to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
