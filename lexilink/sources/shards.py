"""Numbered shards of fixed row counts on disk, with ragged or fixed-size arrays, and their readers.

A store is a folder with one partition per shard (`shard=0`, `shard=1`, ...); rows keep their position in the shard. All shards but the last have `shard_size` rows, so a global row number
gives shard and position by arithmetic, and a reader prunes to that shard. Fixed-size arrays of more dimensions are stored flat with their shape beside them.

A growing store takes more rows later: they fill up the last shard and open new ones. What counts is its manifest, which lists the batches that are whole; a batch that failed half-way is in none and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.functions.encoder import Encoder, encode
from lexilink.operators.settings import digest
from lexilink.operators.sharding import global_row_number, shard_address
from lexilink.sources.manifests import Manifest


def write_shards(df: DataFrame, path: str, by: list[str], shard_size: int = 1_000_000, codec: str = "zstd") -> None:
    """Rows in the order of `by`, flushed to a new shard every shard_size rows."""
    rows = global_row_number(df, by, "row")
    shard, position = shard_address(F.col("row"), shard_size)
    placed = rows.withColumns({"position": position, "shard": shard}).drop("row")
    placed.repartition("shard").sortWithinPartitions("shard", "position").write.mode("error").partitionBy("shard").option("compression", codec).parquet(path)


def flattened(values: Column, depth: int) -> tuple[Column, Column]:
    """(flat array, shape) of a nested array of `depth` dimensions that is rectangular."""
    shape, inner = [F.size(values)], values
    for _ in range(depth - 1):
        shape.append(F.coalesce(F.size(F.get(inner, F.lit(0))), F.lit(0)))
        inner = F.get(inner, F.lit(0))
    flat = values
    for _ in range(depth - 1):
        flat = F.flatten(flat)
    return flat, F.array(*shape)


@dataclass
class ShardStore:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """All rows, with shard and position."""
        return self.spark.read.parquet(self.path)

    def sizes(self) -> DataFrame:
        """(shard, n) by shard."""
        return self.rows().groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))

    def shard_size(self) -> int:
        """Rows per shard; an error where shards but the last differ, or are missing."""
        found = self.sizes().agg(F.max("n").alias("most"), F.count("*").alias("shards"), F.max("shard").alias("last"), F.min(F.struct(-F.col("shard"), "n"))["n"].alias("rest"), F.sum("n").alias("total")).first()
        if not found["shards"]:
            return 0
        if found["last"] + 1 != found["shards"] or found["total"] != found["most"] * (found["shards"] - 1) + found["rest"]:
            raise ValueError(f"shards of {self.path} are not of one size")
        return found["most"]

    def row(self, number: int) -> DataFrame:
        """The row of a global number; only its shard is read."""
        size = self.shard_size()
        return self.rows().where((F.col("shard") == number // size) & (F.col("position") == number % size)).drop("shard", "position")

    def gather(self, wanted: DataFrame, number: str = "row", columns: list[str] | None = None, most_shards: int = 1000, most_rows: int = 1000) -> DataFrame:
        """wanted with the stored columns (all, or those named) of the row that each number says; nulls where the store has no such row or the number is null.

        One job for all rows. Only shards that are asked for are read, and where few rows are asked for, only parts of files that may hold their positions."""
        size = max(1, self.shard_size())
        shard, position = shard_address(F.col(number), size)
        asked = wanted.withColumns({"__shard": shard, "__position": position})
        stored = self.rows()
        kept = [c for c in (columns or stored.columns) if c not in ("shard", "position")]
        which = [r[0] for r in asked.where("__shard IS NOT NULL").select("__shard").distinct().limit(most_shards + 1).collect()]
        if len(which) <= most_shards:
            stored = stored.where(F.col("shard").isin(which))
            at = [r[0] for r in asked.where("__position IS NOT NULL").select("__position").distinct().limit(most_rows + 1).collect()]
            if len(at) <= most_rows:
                stored = stored.where(F.col("position").isin(at))
        stored = stored.select(F.col("shard").alias("__s"), F.col("position").alias("__p"), *kept)
        met = asked.join(stored, (F.col("__shard") == F.col("__s")) & (F.col("__position") == F.col("__p")), "left")
        return met.drop("__shard", "__position", "__s", "__p")

    def shards(self) -> Iterator[DataFrame]:
        """Shard after shard, each in the order of its rows."""
        for r in self.sizes().orderBy("shard").select("shard").toLocalIterator():
            yield self.rows().where(F.col("shard") == r["shard"]).orderBy("position").drop("shard", "position")

    def arrays(self, shard: int, key: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, offsets) of a list column of one shard."""
        column = self.rows().where(F.col("shard") == shard).orderBy("position").select(key).toArrow().column(0).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


class GrowingStore(ShardStore):
    """A store that is appended to. Its manifest has the shard size, the number of rows and the batches. A batch holds many small shards to a file, with shard and position as columns, so a reader of one shard skips the files and row groups of others."""

    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path}/manifest")

    def rows(self) -> DataFrame:
        known = self.manifest().read()
        if known is None:
            raise ValueError(f"{self.path} holds no store yet")
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in known["batches"]]).drop("batch")

    def shard_size(self) -> int:
        known = self.manifest().read()
        return known["shard_size"] if known else 0

    def append(self, df: DataFrame, by: list[str], shard_size: int = 1_000_000, codec: str = "zstd") -> int:
        """Rows in the order of `by` after those that are there; returns how many rows the store has now. The shard size is that of the first batch. Of two writers at once the later one is told to try again."""
        manifest = self.manifest()
        versions = manifest.versions()
        known = manifest.read() or {"shard_size": shard_size, "rows": 0, "batches": []}
        numbered = global_row_number(df, by, "row", known["rows"])
        shard, position = shard_address(F.col("row"), known["shard_size"])
        batch = f"{len(known['batches']):06d}-{uuid.uuid4().hex}"
        placed = numbered.withColumns({"position": position, "shard": shard}).drop("row")
        placed.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").write.mode("error").option("compression", codec).parquet(f"{self.path}/batch={batch}")
        n = self.spark.read.schema(placed.schema).parquet(f"{self.path}/batch={batch}").count()
        after = {"shard_size": known["shard_size"], "rows": known["rows"] + n, "batches": known["batches"] + [batch] if n else known["batches"]}
        if not manifest.publish((versions[-1] if versions else 0) + 1, after):
            raise RuntimeError(f"another writer appended to {self.path}; append again")
        return after["rows"]


def _among(column: str, numbers: list[int]) -> Column:
    """Is a column one of these ascending numbers: by the ranges that they make up, which are few where numbers run on."""
    ranges: list[list[int]] = []
    for n in numbers:
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return reduce(lambda a, b: a | b, [F.col(column).between(*r) for r in ranges], F.lit(False))


class FolderStore(ShardStore):
    """A store whose rows lie in the folders that a manifest lists, in the order of shards, many small shards to a file; shard and position are columns, so a reader of one shard skips the files and row groups of others."""

    def rows(self) -> DataFrame:
        known = Manifest(self.spark, f"{self.path}/manifest").read()
        schema = "uid long, embedding array<float>, position long, shard long"
        folders = [f"{self.path}/vectors/{f}" for f in known["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


@dataclass
class EmbeddedShards:
    """Embeddings of a table's texts in shards, written a few at a time, so that a run that was killed goes on where it stopped.

    `rows` holds the texts by shard and position; `vectors` the embeddings, a folder for each job. The manifest says what they are made with, which shards are whole and which folders hold them; what a killed job left is in no list and is never read.
    Each job of a run writes twice as many shards as the one before it, up to `job_rows` rows, so the jobs of a long run are few, and what a kill costs is no more than what the run had done already.
    """

    spark: SparkSession
    path: str
    job_rows: int = 1_000_000

    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path}/manifest")

    def _publish(self, content: dict) -> dict:
        manifest = self.manifest()
        versions = manifest.versions()
        if not manifest.publish((versions[-1] if versions else 0) + 1, content):
            raise RuntimeError(f"another run writes to {self.path}")
        return content

    def write(self, df: DataFrame, key: str, text_col: str, encoder: Encoder, shard_size: int = 1_000_000, shards_per_job: int = 64, settings: dict | None = None, most_jobs: int | None = None) -> list[int]:
        """Writes the shards that are missing, at most most_jobs times shards_per_job of them, and shards_per_job in the first job; returns their numbers. `settings` say what the encoder is: a folder that was begun with others is an error."""
        made = digest({"key": key, "text": text_col, "shard_size": shard_size, **(settings or {})})
        known = self.manifest().read()
        if known is None:
            numbered = global_row_number(df.select(F.col(key).cast("long").alias("uid"), F.col(text_col).alias("text")), ["uid"], "row")
            shard, position = shard_address(F.col("row"), shard_size)
            placed = numbered.withColumns({"position": position, "shard": shard}).drop("row")
            placed.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").write.mode("overwrite").parquet(f"{self.path}/rows")
            n = self.spark.read.schema(placed.schema).parquet(f"{self.path}/rows").count()
            known = self._publish({"made": made, "rows": n, "shards": -(-n // shard_size), "whole": [], "folders": []})
        if known["made"] != made:
            raise ValueError(f"{self.path} was begun with other settings")
        missing = sorted(set(range(known["shards"])) - set(known["whole"]))
        if most_jobs is not None:
            missing = missing[: most_jobs * shards_per_job]
        at, size = 0, shards_per_job
        while at < len(missing):
            some = missing[at : at + size]
            rows = self.spark.read.schema("uid long, text string, position long, shard long").parquet(f"{self.path}/rows").where(_among("shard", some))
            vectors = encode(rows, "uid", "text", encoder, keep=["position", "shard"])
            folder = f"{some[0]:010d}-{uuid.uuid4().hex}"
            vectors.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").write.parquet(f"{self.path}/vectors/{folder}")
            known = self._publish(known | {"whole": sorted({*known["whole"], *some}), "folders": [*known["folders"], folder]})
            at, size = at + len(some), max(shards_per_job, min(2 * size, self.job_rows // shard_size))
        return missing

    def store(self) -> ShardStore:
        """The whole shards; an error while some are missing."""
        known = self.manifest().read()
        if known is None or len(known["whole"]) < known["shards"]:
            raise ValueError(f"{self.path} lacks shards")
        return FolderStore(self.spark, self.path)
