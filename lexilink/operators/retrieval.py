"""Top-k retrieval over vectors: exact by blocks, and merged over shards.

The queries are a stated set and stay in memory in blocks of bounded size; the index side is streamed in Arrow batches, so each task multiplies one
batch by `query_block` queries at a time and keeps the k best rows of each query so far. What is shuffled is k rows per query and task, merged by a final top-k.
Scores are rounded to `DIGITS` decimals before ranking, so that the order doesn't hang on how a matrix product was blocked; ties go to the smaller uid.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9
METRICS = ("ip", "l2")


def _matrix(column: pa.Array) -> np.ndarray:
    """n x d doubles from a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def score_block(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Scores, higher is better: inner products, or negative squared distances."""
    if metric == "ip":
        return np.round(queries @ vectors.T, DIGITS)
    # Differences rather than |x|^2 - 2xy + |y|^2, which cancels; a block at a time bounds the memory.
    return np.round(-np.stack([((vectors - q) ** 2).sum(axis=1) for q in queries]), DIGITS)


def best_of(scores: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the query, column) of the k best of each row; ties by uid."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero(scores >= kth)
    else:
        rows, columns = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((uids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


class RunningTop:
    """The k best (row, uid, score) of each query over all that was added."""

    def __init__(self, k: int):
        self.k = k
        self.rows, self.uids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, uids: np.ndarray, scores: np.ndarray) -> None:
        rows, uids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.uids, uids), (self.scores, scores)))
        order = np.lexsort((uids, -scores, rows))
        ordered = rows[order]
        kept = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < self.k]
        self.rows, self.uids, self.scores = rows[kept], uids[kept], scores[kept]


#: Scores that are held at once: what a task takes doesn't grow with queries or vectors beyond the queries themselves and their best rows.
MOST_SCORES, QUERY_BLOCK = 1 << 21, 1024


def add_best(top: RunningTop, rows: np.ndarray, queries: np.ndarray, uids: np.ndarray, vectors: np.ndarray, metric: str) -> None:
    """Adds the best of vectors for some queries (at most QUERY_BLOCK), whose numbers are rows, a few vectors at a time."""
    step = max(1, MOST_SCORES // max(1, len(rows)))
    for at in range(0, len(vectors), step):
        part = slice(at, at + step)
        scores = score_block(queries, vectors[part], metric)
        r, c = best_of(scores, uids[part], top.k)
        top.add(rows[r], uids[part][c], scores[r, c])


def partial_top_k(index: DataFrame, mentions: np.ndarray, queries: np.ndarray, k: int, metric: str, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(mention, uid, score): the k best of each task's share of index (uid, embedding)."""
    shared = index.sparkSession.sparkContext.broadcast((mentions, queries))

    def run(iterator):
        ids, q = shared.value
        tops = [RunningTop(k) for _ in range(0, len(ids), query_block)]
        for batch in iterator:
            if not batch.num_rows or not len(ids):
                continue
            uids, vectors = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for b, top in enumerate(tops):
                part = q[b * query_block : (b + 1) * query_block]
                add_best(top, np.arange(len(part)), part, uids, vectors, metric)
        for b, top in enumerate(tops):
            yield pa.RecordBatch.from_arrays([pa.array(ids[b * query_block + top.rows]), pa.array(top.uids), pa.array(top.scores)], ["mention", "uid", "score"])

    return index.select("uid", "embedding").where(F.col("embedding").isNotNull()).mapInArrow(run, "mention long, uid long, score double")


def merge_top_k(partial: DataFrame, k: int) -> DataFrame:
    """(mention, rank, uid, score) from partial results of any sharding."""
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "uid")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("mention", "rank", "uid", "score")


def query_blocks(queries: DataFrame, most: int = 200_000, size: int = 256 << 20):
    """(mentions, matrix) blocks of at most `most` queries and about `size` bytes: what is broadcast at once is bounded."""
    rows = queries.select("mention", "embedding").where(F.col("embedding").isNotNull())
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-found["n"] // max(1, min(most, size // (8 * max(1, found["d"]))))))
    for b in range(blocks):
        table = rows.where(F.pmod(F.xxhash64("mention"), F.lit(blocks)) == b).toArrow().combine_chunks()
        yield table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32())))


def knn(queries: DataFrame, index: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Exact top-k of each query (mention, embedding) in index (uid, embedding). Fewer than k rows where the index is smaller."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric} is none of {METRICS}")
    parts = [partial_top_k(index, ids, q, k, metric) for ids, q in query_blocks(queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merge_top_k(out, k)


def ivf_parameters(n: int, factor: float = 1.0) -> tuple[int, int]:
    """(cells, cells to probe): floor(sqrt(n)) and floor(sqrt(cells) * factor), at least 1."""
    cells = max(1, math.isqrt(n))
    return cells, max(1, math.floor(math.sqrt(cells) * factor))


#: Names of the index kinds in a factory string.
INDEX_KINDS = {"flat": "Flat", "ivf": "IVF{cells},Flat", "pq": "PQ{codes}x{bits}", "ivfpq": "IVF{cells},PQ{codes}x{bits}", "ivfpf": "IVF{cells},PQ{codes}x{bits}"}


def factory_string(kind: str, n: int, codes: int = 16, bits: int = 8, opq: bool = False) -> str:
    """What a vector-index library would build for these settings."""
    if kind not in INDEX_KINDS:
        raise ValueError(f"index {kind} is none of {sorted(INDEX_KINDS)}")
    text = INDEX_KINDS[kind].format(cells=ivf_parameters(n)[0], codes=codes, bits=bits)
    return f"OPQ{codes},{text}" if opq and "PQ" in text else text


def sampled_vectors(index: DataFrame, sample: int) -> np.ndarray:
    """At most `sample` vectors, those with the smallest hashes of their uids; no partition sends much more than its share to the driver."""
    rows = index.where(F.col("embedding").isNotNull()).select("uid", "embedding", F.xxhash64("uid").alias("place"))
    n = rows.count()
    if n > 2 * sample:
        rows = rows.where(F.col("place") <= int(-(2.0**63) + 2.0**64 * 1.2 * sample / n))
    table = rows.orderBy("place", "uid").limit(sample).select("embedding").toArrow().combine_chunks()
    return _matrix(table.column(0).combine_chunks()) if table.num_rows else np.zeros((0, 0))
