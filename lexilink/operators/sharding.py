"""Row numbers, shards, chunks and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_borders(df: DataFrame, column: str, parts: int, sample: int = 2000) -> list:
    """At most parts - 1 ascending values that split a column into about equal ranges, from a bounded sample by hash."""
    rows = df.select(column, F.xxhash64(column).alias("__place")).where(F.col(column).isNotNull())
    n = rows.count()
    if n > 2 * sample:
        # A range of hashes with about the sample in it first, so that no partition sends more than its share.
        rows = rows.where(F.col("__place") <= int(-(2.0**63) + 2.0**64 * 1.5 * sample / n))
    values = sorted(r[0] for r in rows.orderBy("__place").limit(2 * sample).select(column).collect())
    return sorted({values[k * len(values) // parts] for k in range(1, parts)}) if values else []


def range_of(value: Column, borders: list) -> Column:
    """How many of the ascending borders are at most value, 0 for null: a binary search, so a row's work grows with the logarithm of the borders. As a lambda's variable the value is made once a row."""
    among = F.array(*map(F.lit, borders))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    step = lambda v: lambda at, n: F.when(F.coalesce(F.get(among, at + n - 1) <= v, F.lit(False)), at + n).otherwise(at)
    return F.get(F.transform(F.array(value), lambda v: F.aggregate(steps, F.lit(0), step(v))), F.lit(0))


def global_row_number(df: DataFrame, by: list[str], name: str = "row", first: int = 0) -> DataFrame:
    """Rows numbered in the order of `by`, without a window over all rows.

    Fixed borders cut the first column into ranges; each range is numbered on its own and shifted by the sizes of those before it, of which there are few. Borders are
    literals of the plan, so a recomputed task numbers as before. Nulls come first.
    """
    borders = range_borders(df, by[0], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("__part", range_of(F.col(by[0]), borders) if borders else F.lit(0))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = ranged.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__local") - 1 + first).drop("__part", "__local", "__before")


def shard_address(row: Column, shard_size: int) -> tuple[Column, Column]:
    """(shard, position) of a global row number."""
    return F.floor(row / shard_size).cast("long"), (row % shard_size).cast("long")


def chunk_sizes(total: int, parts: int) -> list[int]:
    """Near-equal contiguous chunks: the first total mod parts get one more."""
    return [total // parts + (k < total % parts) for k in range(parts)]


def near_equal_chunk(row: Column, total: Column, parts: int) -> Column:
    """The chunk (from 1) of a row number from 0, as ntile() would give, by arithmetic alone."""
    small = F.floor(total / parts)
    extra = total % parts
    border = extra * (small + 1)
    return F.when(row < border, F.floor(row / (small + 1))).otherwise(extra + F.floor((row - border) / F.greatest(small, F.lit(1)))).cast("int") + 1
