"""Run bookkeeping: digests of settings, run ids, names, and policies over metric logs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilink.operators.dictionary import assign_codes, ordinal


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexilink-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder. What stands there when the driver's JVM ends goes."""
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    fs, p = hadoop_file(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return path


def config_digest(settings: dict[str, Column]) -> Column:
    """SHA-256 of the settings as JSON with sorted keys and all values as strings."""
    return F.sha2(F.to_json(F.struct(*[settings[k].cast("string").alias(k) for k in sorted(settings)])), 256)


def register_runs(digests: DataFrame, known: DataFrame | None) -> DataFrame:
    """(digest, run): known digests keep their run, new ones get the next numbers; the first is 0."""
    if known is None:
        return ordinal(digests.distinct(), "digest", "run").select("digest", "run")
    return assign_codes(digests.distinct(), known, "digest", "run")


def run_name(base: Column, **suffixes: Column) -> Column:
    return F.concat(base, *[F.when(on, F.lit(f"_{name}")).otherwise(F.lit("")) for name, on in suffixes.items()])


def parse_specs(df: DataFrame, column: str) -> DataFrame:
    """corpus, split and type of `<corpus>.<split>.<type>`; another number of parts is an error."""
    parts = F.split(column, r"\.", -1)
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not <corpus>.<split>.<type>: "), F.col(column))))
    return df.withColumn("__p", checked.cast("array<string>")).select(*df.columns, *[F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(("corpus", "split", "type"))])


def warmup_steps(setting: Column, total: Column, absolute: Column) -> Column:
    """A number of steps as it is, or a fraction of all steps."""
    return F.when(absolute, setting).otherwise(F.floor(total * setting)).cast("long")


def with_steps(log: DataFrame) -> DataFrame:
    return log.withColumn("step", F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id")))


def running_loss(log: DataFrame) -> DataFrame:
    """Sum so far by the index of the step (from 0; null at the first) and by the number of steps."""
    total = F.sum("metric").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return with_steps(log).withColumn("total", total).withColumn("by_index", F.when(F.col("step") > 1, F.col("total") / (F.col("step") - 1))).withColumn("mean", F.col("total") / F.col("step"))


def best_so_far(log: DataFrame) -> DataFrame:
    """Steps whose metric is greater than all before it."""
    before = F.max("metric").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return with_steps(log).withColumn("before", before).where(F.col("before").isNull() | (F.col("metric") > F.col("before"))).select("run", "step", "metric")


def every(steps: DataFrame, n: int) -> DataFrame:
    """Every n-th step, counted from 1."""
    return steps.where(F.col("step") % n == 0)


def by(*columns: str) -> Window:
    return Window.partitionBy(*columns)


def zipped(parts: dict[str, DataFrame], place: str) -> DataFrame:
    """Columns of several numbered files side by side; a place that one of them lacks is an error."""
    whole = None
    for name, df in parts.items():
        whole = df if whole is None else whole.join(df, place, "full")
    checked = [F.when(F.col(n).isNull(), F.raise_error(F.concat(F.lit(f"{n} has no line "), F.col(place).cast("string")))).otherwise(F.col(n)).cast("string").alias(n) for n in parts]
    return whole.select(place, *checked)


def hadoop_file(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark itself would open it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_file(spark, path)
    fs.delete(p, True)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a folder has its marker, in any file system that Spark knows."""
    fs, p = hadoop_file(spark, f"{path}/_DONE")
    return fs.exists(p)


def mark_done(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_file(spark, f"{path}/_DONE")
    fs.create(p, True).close()
