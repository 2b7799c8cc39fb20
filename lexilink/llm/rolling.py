"""Features of a time window before each row: counts, sums, distinct labels and exact quantiles.

Rows are first counted by (key, time, value, label), so rows that agree in all four travel as one. The time line of each key is cut in chunks of `chunk_windows` times the longest window; a chunk
also gets the counts of the longest window before it, so every chunk is swept by itself and one key with a third of all rows is spread over as many tasks as it has chunks. In a chunk two pointers
move over the counts in order of time: counts enter a window when a later time is asked for and leave it when they are older than its length. Each window keeps reference counts of labels, a
sum, and two heaps for each quantile: the values up to the asked rank and those beyond it. A value that leaves stays in its heap as a tombstone until it comes to the top or until tombstones are
the larger part, and before each answer values move between the heaps until the lower one just reaches the rank, which changes with the number of values. A task holds the distinct
counts of one window and nothing else. The answers of each (key, time) are joined with the rows again.

Edge cases: a null key is a key of its own; a row with a null time is in no window and its own window is empty; a null value counts as a row without a value, a null label isn't counted among
labels; an empty window has counts and sums of 0 and null quantiles; rows of equal time aren't in each other's window; repeated rows count each, and each gets its answers; a table without rows
gives one without rows. Only the named columns are read, and only those of `carry` come along, so other columns may have any names.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilink.llm.common import Scratch, written


class RankHeaps:
    """The value of a rank among a changing multiset: `low` holds the values up to it, `high` those beyond; values are held once, with their counts."""

    def __init__(self) -> None:
        self.low: list[int] = []  # negated: the largest comes first
        self.high: list[int] = []
        self.count: dict[int, int] = {}
        self.in_low: dict[int, bool] = {}
        self.n_low = self.dead = 0

    def add(self, value: int, n: int) -> None:
        held = self.count.get(value)
        if held is None:
            below = not (self.high and value > self.high[0])
            self.in_low[value] = below
            heappush(self.low, -value) if below else heappush(self.high, value)
            held = 0
        elif held == 0:
            self.dead -= 1
        self.count[value] = held + n
        if self.in_low[value]:
            self.n_low += n

    def remove(self, value: int, n: int) -> None:
        left = self.count[value] = self.count[value] - n
        if self.in_low[value]:
            self.n_low -= n
        if left == 0:
            self.dead += 1
            if self.dead > 64 and 2 * self.dead > len(self.count):
                self._bury()

    def _bury(self) -> None:
        self.count = {v: n for v, n in self.count.items() if n}
        self.in_low = {v: self.in_low[v] for v in self.count}
        self.low = [-v for v, below in self.in_low.items() if below]
        self.high = [v for v, below in self.in_low.items() if not below]
        heapify(self.low)
        heapify(self.high)
        self.dead = 0

    def _forget(self, value: int) -> None:
        del self.count[value], self.in_low[value]
        self.dead -= 1

    def at(self, rank: int) -> int:
        """The value of a rank from 1 to the number of values."""
        while self.n_low < rank:
            value = heappop(self.high)
            n = self.count[value]
            if n == 0:
                self._forget(value)
                continue
            heappush(self.low, -value)
            self.in_low[value] = True
            self.n_low += n
        while True:
            value = -self.low[0]
            n = self.count[value]
            if n == 0:
                heappop(self.low)
                self._forget(value)
            elif self.n_low - n >= rank:
                heappop(self.low)
                heappush(self.high, value)
                self.in_low[value] = False
                self.n_low -= n
            else:
                return value


class Window:
    """What the counts of the last `length` seconds before a time add up to."""

    def __init__(self, length: int, quantiles: tuple[tuple[int, int], ...]) -> None:
        self.length, self.quantiles = length, quantiles
        self.held: deque[tuple] = deque()
        self.heaps = [RankHeaps() for _ in quantiles]
        self.labels: dict = {}
        self.rows = self.values = self.total = 0

    def add(self, time: int, value: int | None, label, n: int) -> None:
        self.held.append((time, value, label, n))
        self.rows += n
        if label is not None:
            self.labels[label] = self.labels.get(label, 0) + n
        if value is not None:
            self.values += n
            self.total += n * value
            for heaps in self.heaps:
                heaps.add(value, n)

    def move_to(self, time: int) -> None:
        while self.held and self.held[0][0] < time - self.length:
            _, value, label, n = self.held.popleft()
            self.rows -= n
            if label is not None:
                left = self.labels[label] - n
                if left:
                    self.labels[label] = left
                else:
                    del self.labels[label]
            if value is not None:
                self.values -= n
                self.total -= n * value
                for heaps in self.heaps:
                    heaps.remove(value, n)

    def answer(self) -> list:
        ranks = [heaps.at(-(-a * self.values // b)) if self.values else None for heaps, (a, b) in zip(self.heaps, self.quantiles, strict=True)]
        return [self.rows, self.total, len(self.labels), *ranks]


class Sweep:
    """One chunk: counts come by ascending time; a time that is the chunk's own is answered with the counts before it."""

    def __init__(self, lengths: tuple[int, ...], quantiles: tuple[tuple[int, int], ...]) -> None:
        self.windows = [Window(w, quantiles) for w in lengths]
        self.waiting: list[tuple] = []  # the counts of the last time
        self.time: int | None = None

    def feed(self, time: int, value: int | None, label, n: int, own: bool) -> list | None:
        """The answers for `time`, where it is new and the chunk's own."""
        found = None
        if time != self.time:
            for row in self.waiting:
                for window in self.windows:
                    if row[0] >= time - window.length:
                        window.add(*row)
            self.waiting, self.time = [], time
            for window in self.windows:
                window.move_to(time)
            if own:
                found = [x for window in self.windows for x in window.answer()]
        self.waiting.append((time, value, label, n))
        return found


def swept(counts: DataFrame, lengths: tuple[int, ...], quantiles: tuple[tuple[int, int], ...], chunk_windows: int) -> DataFrame:
    """(key, time, a0, a1, ...): the answers of all windows, one after another, for each (key, time) of counts (key, time, value, label, n)."""
    longest = max(lengths)
    span = longest * chunk_windows
    chunk = F.expr(f"(time - pmod(time, {span}L)) div {span}L")
    later = F.col("time") >= (F.col("chunk") + 1) * F.lit(span) - longest
    placed = counts.withColumn("chunk", chunk).withColumn("late", F.explode(F.when(later, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = placed.select("key", (F.col("chunk") + F.col("late")).alias("chunk"), "time", "value", "label", "n", (F.col("late") == 0).alias("own"))
    answers = [f"a{i}" for i in range(len(lengths) * (3 + len(quantiles)))]
    kind = counts.schema["key"].dataType.simpleString()

    def run(iterator):
        at, sweep = None, None
        for batch in iterator:
            keys, times, out = [], [], [[] for _ in answers]
            for key, part, time, value, label, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sweep is None or (key, part) != at:
                    at, sweep = (key, part), Sweep(lengths, quantiles)
                found = sweep.feed(time, value, label, n, own)
                if found is not None:
                    keys.append(key)
                    times.append(time)
                    for column, x in zip(out, found, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(times, pa.int64()), *(pa.array(c, pa.int64()) for c in out)], ["key", "time", *answers])

    ordered = placed.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "time")
    return ordered.mapInArrow(run, f"key {kind}, time long, " + ", ".join(f"{a} long" for a in answers))


def rolling_features(
    rows: DataFrame,
    carry: list[str],
    key: Column,
    time: Column,
    value: Column,
    label: Column,
    lengths: tuple[int, ...] = (600, 43_200),
    quantiles: tuple[tuple[int, int], ...] = ((1, 2), (9, 10)),
    chunk_windows: int = 2,
) -> DataFrame:
    """One row for each row and window length: the columns of carry, window_s, event_s, n_rows, total, n_labels, q0, q1, ...: number ceil(a * m / b) of the window's m values for each quantile (a, b).

    Times are whole seconds; a window of W holds the rows of the same key with time - W <= their time < time. carry's columns may have any names but these. Written to the shared folder."""
    base = rows.select(key.alias("key"), time.cast("long").alias("time"), value.cast("long").alias("value"), label.alias("label"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    with Scratch(rows.sparkSession) as scratch:
        base = scratch.written(base, "timed-rows")  # texts are read once
        counts = base.where("time IS NOT NULL").groupBy("key", "time", "value", "label").agg(F.count("*").alias("n"))
        found = swept(counts, lengths, quantiles, chunk_windows).withColumnsRenamed({"key": "of", "time": "at"})
        joined = base.join(found, base["key"].eqNullSafe(found["of"]) & (base["time"] == found["at"]), "left")
        names = ["n_rows", "total", "n_labels", *(f"q{i}" for i in range(len(quantiles)))]
        per = len(names)
        windows = [F.struct(F.lit(w).cast("long").alias("window_s"), *[(F.coalesce(f"a{k * per + i}", F.lit(0)) if i < 3 else F.col(f"a{k * per + i}")).alias(name) for i, name in enumerate(names)]) for k, w in enumerate(lengths)]
        out = joined.select("carried", "time", F.explode(F.array(*windows)).alias("w")).select("carried.*", F.col("w.window_s").alias("window_s"), F.col("time").alias("event_s"), *[F.col(f"w.{n}").alias(n) for n in names])
        return written(out, "rolling-features")
