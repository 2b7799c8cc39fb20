"""Parallel text files: several files whose n-th lines belong together, written in one pass and zipped again by line numbers that the files themselves don't hold.

Lines are numbered from the order of files (natural sort of their paths), of a file's splits (by their first byte) and of lines in a split. A first pass counts the lines of each split; what a
split starts with is then a running sum over splits, of which there are as many as tasks. A task numbers the lines of its splits as it streams them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilink.functions.text import natural_key
from lexilink.operators import runs
from lexilink.sources.writers import one_line


def write_parallel(rows: DataFrame, by: list[str], columns: list[str], path: str) -> None:
    """A folder `file=NAME` of text files for each column, line by line in the order of `by`. Line breaks in values become spaces, nulls empty lines.

    One job writes all: each task sorts a range of rows once for each file, ties by all columns, so the files of a range have the same lines in the same order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(F.struct(*[F.col(c) for c in by]).alias("by"), *[one_line(F.col(c).cast("string")).alias(f"_{c}") for c in columns]).repartitionByRange(n, "by")
    files = F.explode(F.array(*[F.struct(F.lit(c).alias("file"), F.col(f"_{c}").alias("value")) for c in columns]))
    each = ranged.withColumn("f", files).sortWithinPartitions("f.file", "by", *[f"_{c}" for c in columns])
    each.select("f.file", "f.value").write.mode("error").partitionBy("file").text(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines of plain text with their file and the first byte of their split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered_lines(spark: SparkSession, path: str, name: str = "value", first: int = 0, broadcast_splits: int = 500_000) -> DataFrame:
    """(place, name): the lines of the text files in a folder or file, numbered from `first`."""
    lines = split_lines(spark, path)
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("key", natural_key(F.col("file")))
    of_file = sizes.groupBy("key", "file").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("key", "file").rowsBetween(Window.unboundedPreceding, -1)  # over names of files
    before = of_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "file").select("file", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(iterator):
        at, n = None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            codes = files.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]))
            within = np.arange(len(blocks))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
                key = files.dictionary[int(codes[a])].as_py(), int(blocks[a])
                n = n if key == at else 0
                within[a:b] += n - a
                at, n = key, n + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], [*batch.schema.names, "within"])

    counted = lines.mapInArrow(run, "value string, file string, block long, within long")
    side = F.broadcast(starts) if starts.count() <= broadcast_splits else starts
    return counted.join(side, ["file", "block"]).select((F.col("start") + F.col("within") + first).alias("place"), F.col("value").alias(name))


def read_parallel(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(place, columns): the files of write_parallel, or files of others in `file=NAME` folders, zipped by line; files of other lengths are an error."""
    return runs.zipped({c: numbered_lines(spark, f"{path}/file={c}", c) for c in columns}, "place")


def write_names(names: DataFrame, id_col: str, name_col: str, path: str) -> None:
    """Per id one JSON line {id: [its distinct names in order]}."""
    each = names.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.array_sort(F.collect_set(name_col)).alias("names"))
    each.select(F.to_json(F.create_map("id", "names")).alias("value")).write.mode("error").text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, names) of such a file."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("id", "names"))
