import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilink.llm.rolling import RankHeaps, Sweep, rolling_features

SCHEMA = "doc_id long, source string, at long, chars long, lang string"


def brute(rows, lengths, quantiles=((1, 2), (9, 10))):
    out = []
    for doc, source, at, *_ in rows:
        for w in lengths:
            inside = [r for r in rows if at is not None and r[2] is not None and r[1] == source and at - w <= r[2] < at]
            values = sorted(r[3] for r in inside if r[3] is not None)
            ranks = [values[-(-a * len(values) // b) - 1] if values else None for a, b in quantiles]
            out.append((doc, w, at, len(inside), sum(values), len({r[4] for r in inside} - {None}), *ranks))
    return Counter(out)


def found(spark, rows, lengths, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_rows", F.lit("theirs")).withColumn("key", F.lit(1)).withColumn("time", F.lit(None).cast("string"))
    out = rolling_features(df, ["doc_id"], F.col("source"), F.col("at"), F.col("chars"), F.col("lang"), lengths=lengths, **options)
    assert out.columns == ["doc_id", "window_s", "event_s", "n_rows", "total", "n_labels", "q0", "q1"]
    return Counter(tuple(r) for r in out.collect())


def test_heaps_hold_any_rank_under_adds_and_removals():
    rng = np.random.default_rng(1)
    heaps, held = RankHeaps(), []
    for _ in range(4000):
        if held and rng.random() < 0.5:
            v = held.pop(int(rng.integers(len(held))))
            heaps.remove(v, 1)
        else:
            v = int(rng.integers(0, 60)) if rng.random() < 0.5 else int(rng.integers(0, 10**6))
            held.append(v)
            heaps.add(v, 1)
        if held:
            rank = int(rng.integers(1, len(held) + 1))
            assert heaps.at(rank) == sorted(held)[rank - 1]
    assert len(heaps.low) + len(heaps.high) == len(heaps.count) and len(heaps.count) <= 2 * len(set(held)) + 66


def test_tombstones_are_buried():
    heaps = RankHeaps()
    for v in range(10_000):
        heaps.add(v, 1)
        if v >= 10:
            heaps.remove(v - 10, 1)
    assert len(heaps.low) + len(heaps.high) < 200 and heaps.at(1) == 9990


def test_a_sweep_holds_one_window_only():
    sweep = Sweep((100,), ((1, 2),))
    for t in range(5000):
        sweep.feed(t, t % 7, "a", 1, True)
    assert len(sweep.windows[0].held) <= 101


@pytest.mark.parametrize("chunk_windows", [1, 3])
def test_equals_brute_force(spark, chunk_windows):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.4
        source = "hot" if hot else [None, "a", "b"][int(rng.integers(3))]
        at = None if rng.random() < 0.03 else int(rng.integers(-4000, 4000)) // 20 * 20
        rows.append((None if rng.random() < 0.02 else i, source, at, None if rng.random() < 0.1 else int(rng.integers(0, 30)), [None, "x", "y", "z"][int(rng.integers(4))]))
    rows += rows[:20]
    lengths = (60, 1000)
    assert found(spark, rows, lengths, chunk_windows=chunk_windows) == brute(rows, lengths)


def test_ties_and_borders(spark):
    rows = [(k, "s", t, v, "en") for k, (t, v) in enumerate([(0, 5), (0, 7), (600, 1), (600, 2), (1199, 3), (1200, 4), (1201, 9), (43_200, 8)])]
    assert found(spark, rows, (600, 43_200)) == brute(rows, (600, 43_200))


def test_no_rows_and_null_columns(spark):
    assert not found(spark, [], (600,))
    rows = [(None, None, None, None, None), (1, None, 0, None, None), (2, None, 60, None, None)]
    got = found(spark, rows, (600,))
    assert got == brute(rows, (600,)) and (2, 600, 60, 1, 0, 0, None, None) in got


def test_the_query_takes_times_from_ids(spark):
    from lexilink.llm.queries import op13_rolling_window_features

    got = op13_rolling_window_features(spark, "/root/testdata/sf0.001")
    for r in got.where("window_s = 600").limit(20).collect():
        assert r["event_s"] == 60 * ((r["doc_id"] + zlib.crc32(str(r["doc_id"]).encode()) % 10_000) // 6)
