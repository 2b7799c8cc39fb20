"""Line deduplication over levelled sorted runs of line hashes. Native: DataFrame operations only.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased; keys shorter than `min_chars`
code points are never dropped. Keys are held as two 64-bit hashes. Documents are taken in batches by
descending id. Each batch becomes a sorted run (key, number of documents); a merge-anti-join with the runs written so far
leaves the keys that no earlier batch had, and their largest document of this batch is their holder, which
makes it the largest of all. When a level has `fanout` runs they are merged into one of the next level, so a batch meets about log(batches) runs; the totals are the sum of what runs are left. Batches hold about
`batch_lines` lines each; there are at least 4 and at most 16 of them, so that compaction has at least two levels and the number of jobs stays bounded. Runs are bucketed by key and sorted in each bucket, in the warehouse, so anti-joins with runs read buckets
side by side and shuffle nothing.

Keys in at least `min_docs` documents lose all their lines but those of the holder.

Edge cases: a null or empty text is one empty line; a repeated id counts as many documents as it has rows, and all rows with a
holder's id keep their lines; a null id sorts below all others; a table without rows gives one without rows; further
columns are carried along. Ids are numbers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilink.llm.common import Scratch, ascii_lower, beside, free_name, written

_KEY = ["h1", "h2"]


def row_mark(text: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, mark, pos (from 0), h1, h2 of every line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    exploded = docs.select(F.col(id_col).alias("doc"), row_mark(text).alias("mark"), F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"))
    keyed = exploded.select("doc", "mark", "pos", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), "key").alias("h2")
    )


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs) as bucketed tables."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 2):
        self.scratch, self.spark, self.buckets, self.fanout = scratch, scratch.spark, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self._name, self._made = f"line_runs_{uuid.uuid4().hex}", 0

    def _write(self, df: DataFrame) -> str:
        name = f"{self._name}_{self._made}"
        self._made += 1
        (df.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("compression", "zstd").saveAsTable(name))
        return name

    def _all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        # The files are read without their buckets: a union of bucketed tables may be grouped as if it were bucketed itself, which splits keys.
        files = [f for n in names for f in self.spark.table(n).inputFiles()]
        schema = "h1 long, h2 long, n_docs long"
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of keys (bucketed alike) that no run has."""
        return reduce(lambda left, name: left.join(self.spark.table(name).select(*_KEY), _KEY, "left_anti"), self._all(), keys)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch with one row per key and document; returns (h1, h2, holder) of keys not seen before."""
        counted = batch.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("holder"))
        name = self._write(counted)
        holders = self.scratch.written(self.fresh(self.spark.table(name)).select(*_KEY, "holder"), "line-holders")
        self.levels[0].append(name)
        self._compact()
        return holders

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                run = self._write(self.merged(level))
                for name in level:
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(run)

    def drop(self) -> None:
        for name in self._all():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs) over all batches."""
        return self.merged(self._all())


def descending_batches(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions on `doc` that split the rows into about equal ranges of ids, the largest ids first."""
    cuts = lines.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = sorted(set(cuts or []))
    if not edges:
        return [F.lit(True)]
    doc = F.col("doc")
    inner = [(doc >= a) & (doc < b) for a, b in zip(edges, edges[1:], strict=False)]
    return [doc >= edges[-1], *inner[::-1], (doc < edges[0]) | doc.isNull()]


def repeated_keys(lines: DataFrame, min_docs: int, batch_lines: int, keys_per_bucket: int = 500_000) -> DataFrame:
    """(h1, h2, holder) of keys in at least min_docs documents, as a written table."""
    with Scratch(lines.sparkSession) as scratch:
        n = lines.count()
        # As many buckets as shuffles have partitions, at least: each task of a shuffle by key then writes one file.
        buckets = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // keys_per_bucket))
        runs = LineRuns(scratch, buckets)
        try:
            holders = [runs.add(lines.where(c).groupBy("doc", *_KEY).agg(F.count("*").alias("n"))) for c in descending_batches(lines, min(16, max(4, -(-n // batch_lines))))]
            return written(reduce(DataFrame.unionByName, holders).join(runs.totals().where(F.col("n_docs") >= min_docs), _KEY).select(*_KEY, "holder"), "repeated-lines")
        finally:
            runs.drop()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batch_lines: int = 20_000_000, broadcast_keys: int = 500_000) -> DataFrame:
    """(doc, mark, drops): the ascending positions of the lines that a document loses; only documents that lose any. Written.

    Repeated keys (24 bytes each) are broadcast while there are at most broadcast_keys, so lines that are very common go to no task of their own; beyond that the join shuffles, and Spark splits frequent keys."""
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.written(keyed_lines(docs, id_col, text_col, min_chars), "keyed-lines")
        repeated = repeated_keys(lines, min_docs, batch_lines)
        side = F.broadcast(repeated) if repeated.count() <= broadcast_keys else repeated
        lost = lines.join(side, _KEY).where(~F.col("doc").eqNullSafe(F.col("holder")))
        return written(lost.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drops")), "dropped-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = True, **options) -> DataFrame:
    """docs with its text less the repeated lines, and with_counts llm_n_lines (before) and llm_n_dropped, to which columns of docs that have these names give way."""
    doc, mark, gone = (free_name(x, docs) for x in ("doc", "mark", "drops"))
    drops = dropped_lines(docs, id_col, text_col, **options).withColumnsRenamed({"doc": doc, "mark": mark, "drops": gone})
    drops = beside(drops, 40 + 4 * F.size(gone))  # texts stay where they are while these are few
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col(doc)) & (row_mark(F.col(text_col)) == F.col(mark)), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # array_except hashes, so a text with many dropped lines stays linear.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    less = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    texts = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(less).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if not with_counts:
        return joined.select(*texts)
    kept_columns = [e for e, c in zip(texts, docs.columns, strict=True) if c.lower() not in ("llm_n_lines", "llm_n_dropped")]
    return joined.select(*kept_columns, F.size(lines).cast("long").alias("llm_n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("llm_n_dropped"))
