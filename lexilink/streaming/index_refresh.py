"""A vector index that is renewed while vectors arrive, and searches that take up the newest one.

Vectors come as a stream; each micro-batch becomes a version of the index. Most versions add a segment: the new vectors in the cells and codes that are there. Once there are `growth` times as many vectors as
were trained on, a version is trained anew over all of them, so training costs a constant share of what arrives. A version is a manifest (sources/manifests.py): the folder of the trained index and its
segments. It is published when all its files are there, in one rename, and never changes; readers hold on to the version that they opened.

A micro-batch that is run again after a failure finds its version published, or writes the same folders over and publishes it: versions follow the batch numbers, and each is made from the version before it. So a folder of
versions belongs to one checkpoint: a stream that starts over needs a new folder.

Edge cases: null vectors are left out; a batch without vectors is a version like the one before; versions without vectors find nothing. Ids that come again are vectors of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexilink.operators import runs
from lexilink.operators.indexstore import VectorIndex
from lexilink.sources.manifests import Manifest


@dataclass
class IndexVersions:
    spark: SparkSession
    path: str
    kind: str = "ivf"
    metric: str = "ip"
    factor: float = 1.0
    growth: float = 2.0

    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path}/versions")

    def open(self, version: int | None = None) -> tuple[int, VectorIndex | None]:
        """(number, index) of a version, the newest unless named; (0, None) before there is any, no index while there are no vectors."""
        found = self.manifest().read(version)
        if found is None:
            return 0, None
        if not found["trained"]:
            return found["version"], None
        index = VectorIndex.open(self.spark, found["trained"])
        index.more = found["segments"]
        return found["version"], index

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """The version of a micro-batch (uid, embedding); nothing to do where it is published."""
        manifest, version = self.manifest(), batch_id + 1
        if version in manifest.versions():
            return
        before = manifest.read(batch_id) or {"rows": 0, "trained": None, "trained_rows": 0, "segments": [], "arrived": []}
        arrived = f"{self.path}/arrived/{version:010d}"
        new = batch.select(F.col("uid").cast("long").alias("uid"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
        new.write.mode("overwrite").parquet(arrived)
        n = self.spark.read.schema("uid long, embedding array<float>").parquet(arrived).count()
        after = before | {"version": version, "rows": before["rows"] + n, "arrived": before["arrived"] + [arrived] * (n > 0)}
        if n and (not before["trained"] or after["rows"] >= self.growth * before["trained_rows"]):
            everything = self.spark.read.schema("uid long, embedding array<float>").parquet(*after["arrived"])
            trained = f"{self.path}/trained/{version:010d}"
            VectorIndex.build(everything, trained, self.kind, self.metric, self.factor, overwrite=True)
            after |= {"trained": trained, "trained_rows": after["rows"], "segments": []}
        elif n:
            segment = f"{self.path}/segments/{version:010d}"
            VectorIndex.open(self.spark, before["trained"]).place(self.spark.read.schema("uid long, embedding array<float>").parquet(arrived), segment)
            after |= {"segments": before["segments"] + [segment]}
        manifest.publish(version, after)

    def expire(self, keep: int) -> None:
        """Forgets all but the newest `keep` versions, and removes the trained indexes and segments that none of these reads."""
        manifest = self.manifest()
        versions = manifest.versions()
        read = {f for v in versions[-keep:] for c in [manifest.read(v)] for f in [c["trained"], *c["segments"]]}
        for v in versions[:-keep]:
            old = manifest.read(v)
            manifest.drop(v)
            for folder in {old["trained"], *old["segments"]} - read - {None}:
                runs.delete(self.spark, folder)

    def refresh(self, arrivals: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the stream that makes versions from arrivals (uid, embedding); by default it takes what is there and ends."""
        return arrivals.writeStream.foreachBatch(lambda df, k: self.add(df, k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class RefreshingSearch:
    """Searches micro-batches of queries (mention, embedding), with the newest version at every `every`-th batch and the one in use in between; each batch's results are a folder `batch=K` that says which version they are of."""

    versions: IndexVersions
    path: str
    k: int = 10
    every: int = 1
    probes: int | None = None
    _open: tuple[int, VectorIndex | None] | None = None

    def search(self, batch: DataFrame, batch_id: int) -> None:
        if self._open is None or batch_id % self.every == 0:
            self._open = self.versions.open()
        version, index = self._open
        spark = self.versions.spark
        found = index.search(batch, self.k, self.probes) if index else spark.createDataFrame([], "mention long, rank int, uid long, score double")
        found.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, queries: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return queries.writeStream.foreachBatch(lambda df, k: self.search(df, k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def results(self) -> DataFrame:
        return self.versions.spark.read.schema("mention long, rank int, uid long, score double, version int, batch long").parquet(self.path)
