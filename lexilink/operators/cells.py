"""Inverted cells for very many vectors: centroids in two levels, trained by distributed k-means, and found again without a matrix of all vectors by all cells.

n vectors get about sqrt(n) cells, in about n^(1/4) coarse cells. Coarse centroids come from k-means over a sample whose rounds are jobs: each task adds up its share by centroid, and only these sums
meet. Then all vectors are counted by coarse cell, which says how many fine cells each one gets and how much of it is sampled. A coarse cell's fine centroids are trained in one task, from
`per_cell` vectors for each of them. Fine centroids stay a table (cell, coarse, center); the driver only ever holds the coarse ones.

A vector's cell is the nearest fine one in its nearest coarse one. Fine centroids are broadcast while they take at most `broadcast_bytes`; beyond that vectors meet the centroids of their coarse cell in a join that deals
large coarse cells to several tasks, each of which streams its vectors past them.

What is fitted comes from bounded samples by hash of the id (`per_cell` vectors for each centroid at most about); every vector gets a cell. Null vectors get none; with no vectors there are no cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilink.operators import runs
from lexilink.operators.retrieval import _matrix

_SPAN = 1 << 40


def closeness(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Larger is nearer."""
    return x @ centers.T - (centers**2).sum(axis=1) / 2


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The nearest centroid of each row; at most `block` scores at a time."""
    step = max(1, block // max(1, len(centers)))
    return np.concatenate([closeness(x[at : at + step], centers).argmax(axis=1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def place(column: str = "uid", turn: int = 0):
    """A number below 2^40 from an id's hash: samples are those below a bound."""
    return F.pmod(F.xxhash64(F.lit(turn), column), F.lit(_SPAN))


def sampled(rows: DataFrame, share: float, turn: int = 0) -> DataFrame:
    return rows if share >= 1 else rows.where(place("uid", turn) < math.ceil(share * _SPAN))


def summed_by(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cell, n, total): the vectors of rows (uid, embedding) added up by nearest centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(iterator):
        c = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
        for batch in iterator:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = nearest(x, c)
                n += np.bincount(own, minlength=len(c))
                np.add.at(total, own, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), _lists(total[some])], ["cell", "n", "total"])

    parts = rows.select("embedding").mapInArrow(run, "cell long, n long, total array<double>")
    d = centers.shape[1]
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(k))).alias(f"x{k}") for k in range(d)]).select("cell", "n", F.array(*[f"x{k}" for k in range(d)]).alias("total"))


def k_means_rounds(rows: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds as jobs; a centroid without vectors stays where it is."""
    for _ in range(rounds):
        moved = centers.copy()
        for r in summed_by(rows, centers).collect():  # a row for each coarse centroid
            moved[r["cell"]] = np.array(r["total"]) / r["n"]
        if np.allclose(moved, centers, atol=1e-9):
            return moved
        centers = moved
    return centers


def k_means_local(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of rows in an order by hash; those that lose all their rows go to the rows that are farthest off."""
    centers = np.unique(x[:k], axis=0)
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        lost = np.flatnonzero(n == 0)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        if len(lost):
            off = ((x - centers[own]) ** 2).sum(axis=1)
            centers[lost] = x[np.argsort(-off, kind="stable")[: len(lost)]]
    return centers


@dataclass
class Cells:
    """coarse: the coarse centroids (of about n^(1/4)); fine: a written table (cell, coarse, center)."""

    coarse: np.ndarray
    fine: DataFrame
    n_fine: int

    def broadcastable(self, most: int) -> bool:
        return self.n_fine * self.coarse.shape[1] * 8 <= most


def train_cells(rows: DataFrame, cells: int, path: str, per_cell: int = 64, coarse_rounds: int = 4, rounds: int = 8) -> Cells:
    """About `cells` cells for rows (uid, embedding), their fine centroids as a table in path."""
    spark = rows.sparkSession
    rows = rows.select("uid", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
    n = rows.count()
    if not n:
        fine = spark.createDataFrame([], "cell long, coarse long, center array<double>")
        return Cells(np.zeros((0, 0)), fine, 0)
    want = max(1, math.isqrt(max(1, cells)))
    kept = f"{path}-sample"
    sampled(rows, 4 * per_cell * want / n).write.mode("overwrite").parquet(kept)
    sample = spark.read.parquet(kept)
    if sample.limit(1).count() == 0:
        sample = rows
    first = sample.select("embedding", place(turn=1).alias("p")).groupBy("embedding").agg(F.min("p").alias("p")).orderBy("p").limit(want).toArrow()
    coarse = k_means_rounds(sample, _matrix(first.column(0).combine_chunks()), coarse_rounds)
    # How many vectors each coarse cell has, over all of them.
    sizes = {r["cell"]: r["n"] for r in summed_by(rows, coarse).select("cell", "n").collect()}
    share = max(1, cells // len(coarse))
    # A coarse cell gets as many cells as its vectors ask for, but no more than four times the even share, so that one task can train them.
    fine_of = {c: max(1, min(4 * share, round(cells * m / n))) for c, m in sizes.items()}
    of = spark.sparkContext.broadcast((coarse, fine_of))
    # Sampled by coarse cell: as many as its fine cells need.
    rates = np.zeros(len(coarse))
    for c, k in fine_of.items():
        rates[c] = min(1.0, per_cell * k / sizes[c])
    shared = spark.sparkContext.broadcast(rates)

    def sort_out(iterator):
        c, _ = of.value
        for batch in iterator:
            if batch.num_rows:
                own = nearest(_matrix(batch.column(2)), c)
                at = batch.column(1).to_numpy(zero_copy_only=False)
                take = np.flatnonzero(at < np.ceil(shared.value[own] * _SPAN))
                yield pa.RecordBatch.from_arrays([pa.array(own[take]), *(x.take(pa.array(take)) for x in (batch.column(1), batch.column(2)))], ["coarse", "p", "embedding"])

    def train(table: pa.Table) -> pa.Table:
        _, fine_of = of.value
        c = table.column("coarse")[0].as_py()
        x = _matrix(table.column("embedding").combine_chunks())[np.argsort(table.column("p").to_numpy(), kind="stable")]
        found = k_means_local(x, fine_of[c], rounds)
        return pa.table({"coarse": pa.array([c] * len(found), pa.int64()), "k": pa.array(range(len(found)), pa.int64()), "center": _lists(found)})

    drawn = rows.select("uid", place(turn=2).alias("p"), "embedding").mapInArrow(sort_out, "coarse long, p long, embedding array<float>")
    trained = drawn.groupBy("coarse").applyInArrow(train, "coarse long, k long, center array<double>")
    # A coarse cell that no sampled vector is in is its own only cell.
    plain = f"{path}-fine"
    trained.write.mode("overwrite").parquet(plain)
    found = spark.read.parquet(plain)
    counts = {r["coarse"]: r["n"] for r in found.groupBy("coarse").agg(F.count("*").alias("n")).collect()}
    bare = [(c, 0, coarse[c].tolist()) for c in range(len(coarse)) if c not in counts]
    base, total = [], 0
    for c in range(len(coarse)):
        base.append((c, total))
        total += counts.get(c, 1)
    whole = found.unionByName(spark.createDataFrame(bare, found.schema)) if bare else found
    numbered = whole.join(F.broadcast(spark.createDataFrame(base, "coarse long, base long")), "coarse").select((F.col("base") + F.col("k")).alias("cell"), "coarse", "center")
    numbered.write.mode("overwrite").parquet(path)
    runs.delete(spark, kept)
    runs.delete(spark, plain)
    return Cells(coarse, spark.read.schema("cell long, coarse long, center array<double>").parquet(path), total)


def _ranked(x: np.ndarray, rows: np.ndarray, centers: np.ndarray, cells: np.ndarray, top: int):
    """(row, cell, closeness) of the `top` nearest of these cells for each row."""
    step = max(1, (1 << 20) // max(1, len(centers)))
    for at in range(0, len(x), step):
        near = closeness(x[at : at + step], centers)
        k = min(top, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
        yield np.repeat(rows[at : at + step], k), cells[best.ravel()], np.take_along_axis(near, best, axis=1).ravel()


def nearest_cells(rows: DataFrame, cells: Cells, id_col: str, top: int = 1, coarse_top: int = 1, broadcast_bytes: int = 64 << 20, share_rows: int = 200_000) -> DataFrame:
    """(id, cell, near, coarse, embedding): the `top` nearest cells of each row (id, embedding) among those of its `coarse_top` nearest coarse cells."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
    schema = f"{id_col} long, cell long, near double, coarse long, embedding array<float>"
    if not cells.n_fine:
        return spark.createDataFrame([], schema)
    coarse_top = min(coarse_top, len(cells.coarse))

    def batch_of(ids, found, near, coarse, vectors):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(near), pa.array(coarse, pa.int64()), vectors], [id_col, "cell", "near", "coarse", "embedding"])

    def coarse_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if coarse_top == 1:
            return nearest(x, c)[:, None]
        return np.argsort(-closeness(x, c), axis=1)[:, :coarse_top]

    if cells.broadcastable(broadcast_bytes):
        table = cells.fine.orderBy("coarse", "cell").toArrow()
        owner, ids = table.column("coarse").to_numpy(), table.column("cell").to_numpy()
        shared = spark.sparkContext.broadcast((cells.coarse, np.searchsorted(owner, np.arange(len(cells.coarse) + 1)), ids, _matrix(table.column("center").combine_chunks())))

        def run(iterator):
            coarse, bounds, ids, centers = shared.value
            # As many rows at once as have about a million candidates and numbers of vectors to return.
            step = max(1, (1 << 20) // max(1, top * centers.shape[1], len(ids) if coarse_top > 1 else 1))
            for batch in (whole.slice(at, step) for whole in iterator for at in range(0, whole.num_rows, step)):
                uids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                own, parts = coarse_of(x, coarse), []
                for c in np.unique(own).tolist():
                    who = np.flatnonzero((own == c).any(axis=1))
                    parts += _ranked(x[who], who, centers[bounds[c] : bounds[c + 1]], ids[bounds[c] : bounds[c + 1]], top)
                r, found, near = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.lexsort((found, -near, r))
                r, found, near = r[order], found[order], near[order]
                kept = np.arange(len(r)) - np.searchsorted(r, r) < top
                r, found, near = r[kept], found[kept], near[kept]
                coarse_of_cell = np.searchsorted(bounds, np.searchsorted(ids, found), "right") - 1
                yield batch_of(uids[r], found, near, coarse_of_cell, batch.column(1).take(pa.array(r)))

        return rows.mapInArrow(run, schema)
    shared = spark.sparkContext.broadcast(cells.coarse)

    def sort_out(iterator):
        for batch in iterator:
            if batch.num_rows:
                own = coarse_of(_matrix(batch.column(1)), shared.value)
                r = np.repeat(np.arange(len(own)), own.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(own.ravel().astype(np.int64))], ["id", "embedding", "coarse"])

    placed = rows.mapInArrow(sort_out, "id long, embedding array<float>, coarse long")
    shares = placed.groupBy("coarse").agg(F.ceil(F.count("*") / share_rows).cast("int").alias("shares"))  # a row for each coarse cell
    shares = F.broadcast(shares)
    rest = placed.join(shares, "coarse").select("coarse", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "id", F.col("embedding").cast("array<double>").alias("x"))
    heads = cells.fine.join(shares, "coarse").select("coarse", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("cell").alias("id"), F.col("center").alias("x"))

    def stream(iterator):
        at, ids, centers = None, [], []
        for batch in iterator:
            if not batch.num_rows:
                continue
            coarse, share, kind, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            x = _matrix(batch.column(4))
            for k in np.split(np.arange(len(x)), np.flatnonzero((np.diff(coarse) != 0) | (np.diff(share) != 0) | (np.diff(kind) != 0)) + 1):
                key = coarse[k[0]], share[k[0]]
                if key != at:
                    at, ids, centers = key, [], []
                if kind[k[0]] == 0:
                    ids.append(names[k])
                    centers.append(x[k])
                    continue
                for r, found, near in _ranked(x[k], k, np.concatenate(centers), np.concatenate(ids), top):
                    yield batch_of(names[r], found, near, coarse[r], batch.column(4).cast(pa.list_(pa.float32())).take(pa.array(r)))

    met = heads.unionByName(rest).repartition("coarse", "share").sortWithinPartitions("coarse", "share", "kind", "id").mapInArrow(stream, schema)
    if coarse_top == 1 and top == 1:
        return met
    order = Window.partitionBy(id_col).orderBy(F.desc("near"), "cell")  # at most coarse_top * top rows each
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")
