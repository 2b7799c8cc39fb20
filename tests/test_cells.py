"""Distributed two-level cells against numpy."""

import numpy as np
import pytest

from lexilink.operators import cells as K
from lexilink.operators import indexstore as I
from lexilink.operators import retrieval as R


def table(spark, x, parts=5):
    rows = [(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "uid long, embedding array<float>").repartition(parts)


def clustered(groups=12, size=60, d=16, seed=0):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, d)) * 4
    x = (heads[:, None, :] + rng.normal(size=(groups, size, d)) * 0.4).reshape(-1, d)
    return x.astype(np.float32)


def test_rounds_equal_lloyds(spark):
    x = clustered().astype(np.float64)
    start = x[::97][:6]
    want = start.copy()
    for _ in range(4):
        own = ((x[:, None, :] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.stack([x[own == k].mean(axis=0) if (own == k).any() else want[k] for k in range(6)])
    assert np.allclose(K.k_means_rounds(table(spark, x), start, 4), want, atol=1e-5)


def test_blocks_bound_the_scores():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(500, 8)), rng.normal(size=(30, 8))
    assert (K.nearest(x, c, block=64) == K.closeness(x, c).argmax(axis=1)).all()


@pytest.mark.parametrize("top", [1, 4])
def test_both_ways_give_the_nearest_cells(spark, tmp_path, top):
    x = clustered(seed=2)
    rows = table(spark, [*x, None])
    cells = K.train_cells(rows, 40, f"{tmp_path}/cells")
    assert 20 <= cells.n_fine <= 80 and cells.fine.count() == cells.n_fine and len(cells.coarse) <= 6
    fine = {r["cell"]: np.array(r["center"]) for r in cells.fine.collect()}
    assert sorted(fine) == list(range(cells.n_fine))
    centers = np.stack([fine[k] for k in range(cells.n_fine)])
    near = K.closeness(x.astype(np.float64), centers)
    want = np.sort(-np.sort(-near, axis=1)[:, :top], axis=1)
    for options in ({}, {"broadcast_bytes": 0, "share_rows": 50}):
        found = K.nearest_cells(rows, cells, "uid", top, len(cells.coarse), **options).toPandas()
        assert len(found) == top * len(x)
        got = np.stack([np.sort(g["near"].to_numpy()) for _, g in found.groupby("uid")])
        assert np.allclose(got, want)
    # With one coarse cell each: the nearest one inside it, the same in both ways.
    a, b = ({(r["uid"], r["cell"], r["coarse"], tuple(r["embedding"])) for r in K.nearest_cells(rows, cells, "uid", **o).collect()} for o in ({}, {"broadcast_bytes": 0, "share_rows": 50}))
    assert a == b and len(a) == len(x)
    coarse_of = {r["cell"]: r["coarse"] for r in cells.fine.collect()}
    own = K.nearest(x.astype(np.float64), cells.coarse)
    assert all(coarse_of[cell] == c == own[uid] for uid, cell, c, _ in a)


def test_a_third_of_equal_vectors_and_few_vectors(spark, tmp_path):
    x = [*clustered(4, 40, seed=3), *[np.ones(16, np.float32)] * 80]
    rows = table(spark, x)
    cells = K.train_cells(rows, 16, f"{tmp_path}/a")
    found = K.nearest_cells(rows, cells, "uid", broadcast_bytes=0, share_rows=10).toPandas()
    assert len(found) == len(x) and found[found["uid"] >= 160]["cell"].nunique() == 1
    one = K.train_cells(table(spark, x[:1]), 1, f"{tmp_path}/b")
    assert one.n_fine == 1 and K.nearest_cells(table(spark, x[:1]), one, "uid").count() == 1
    none = K.train_cells(table(spark, [None]), 1, f"{tmp_path}/c")
    assert none.n_fine == 0 and K.nearest_cells(table(spark, [None]), none, "uid").count() == 0


def test_recall_with_a_tenth_of_the_cells_where_vectors_cluster(spark, tmp_path):
    x = clustered(40, 50, seed=4)
    rows = table(spark, x)
    queries = rows.where("uid % 50 = 0").withColumnRenamed("uid", "mention")
    index = I.VectorIndex.build(rows, f"{tmp_path}/i", "ivf")
    probes = max(1, index.trained.n_cells // 10)
    found = {(r.mention, r.uid) for r in index.search(queries, 10, probes).collect()}
    flat = {(r.mention, r.uid) for r in R.knn(queries, rows, 10).collect()}
    assert len(found & flat) >= 0.9 * len(flat)


def test_search_in_small_blocks_of_queries(spark, tmp_path, monkeypatch):
    from functools import partial

    rows = table(spark, clustered(10, 30, seed=5))
    queries = rows.where("uid % 3 = 0").withColumnRenamed("uid", "mention")
    index = I.VectorIndex.build(rows, f"{tmp_path}/i", "ivf", factor=2.0)
    want = {tuple(r) for r in index.search(queries, 5).collect()}
    plain = R.query_blocks
    monkeypatch.setattr(R, "query_blocks", lambda q, most=0: partial(plain, most=20)(q))
    assert {tuple(r) for r in index.search(queries, 5).collect()} == want
