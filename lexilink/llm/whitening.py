"""Whitening of embeddings: a compensated covariance, its eigenvectors, and every vector in their coordinates.

A vector's entries c become whole numbers x = floor(scale * c) + shift. Three passes over the vectors, each a sum by task that tasks further on merge:

1. n and the sums S, as whole numbers.
2. The covariance. Each entry is centred first, x - S/n in double-double (a high part, and a low part that holds what the high part can't). Products of centred entries are split in their rounded
   value and its exact error by Dekker's multiplication, and added in double-double by Knuth's two-sum, rows of a block in a tree, blocks and tasks one after another, high and low parts together.
   So the sums are as good as if made with about 32 digits and rounded once.
3. The covariance of the whitened vectors, made the same way, whose distance from the identity shows what the result is worth.

Between 2 and 3 the driver solves the eigenproblem of one matrix of d x d: Householder reduction to a tridiagonal matrix, then divide and conquer (LAPACK's syevd, which is what numpy's eigh calls).
Sums of tasks are dealt out by rows of the matrix and merged in two steps, so what one task or the driver gets doesn't grow with the number of vectors.

Edge cases: vectors that are null or hold null or non-finite entries are left out, in the fit and in the result; so are empty ones. Where lengths differ the most frequent one counts (of equally
frequent ones the longest) and others are left out. x is held at -2^52 and 2^52. Components whose eigenvalue is at most 1e-14 of the largest are numerically nothing: their whitened values are null and identity_error leaves them
out. A deviation beyond 64 bits is null. Repeated rows count each; a null id is an id; a table without usable vectors gives one without rows. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm.common import arrow_rows

_SPLIT = 134_217_729.0  # 2^27 + 1
_HELD = 2.0**52


def two_sum(a, b):
    """(s, e): s = a + b as rounded, s + e = a + b."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """(high, low) of 26 bits each, a = high + low."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def add_pairs(a, b):
    """The sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def add_rows(high: np.ndarray, low: np.ndarray):
    """The sum over the first axis, in a tree."""
    while len(high) > 1:
        half = len(high) // 2
        h, e = add_pairs((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(high) % 2:
            h, e = np.concatenate([h, high[-1:]]), np.concatenate([e, low[-1:]])
        high, low = h, e
    return high[0], low[0]


def outer_sums(high: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray, products: int = 1 << 16):
    """Sums over rows of z_i * z_j in double-double, z = high + low, for the pairs of columns (i, j); about `products` of them, or one row's, at a time."""
    total = np.zeros(len(i)), np.zeros(len(i))
    rows = max(1, products // len(i))
    for at in range(0, len(high), rows):
        z, w = high[at : at + rows], low[at : at + rows]
        h, e = halves(z)
        a, b = z[:, i], z[:, j]
        p = a * b
        ah, al, bh, bl = h[:, i], e[:, i], h[:, j], e[:, j]
        error = ((ah * bh - p) + ah * bl + al * bh) + al * bl
        error += a * w[:, j] + w[:, i] * b
        total = add_pairs(total, add_rows(*two_sum(p, error)))
    return total


def whole_entries(column: pa.Array, d: int | None, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the batch whose vectors count, their entries x as a matrix); without d only vectors of the batch's own lengths are found, as a list of both by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for size in [d] if d else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        x = flat[starts[rows][:, None] + np.arange(size)]
        ok = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            found[size] = rows[ok], np.clip(np.floor(scale * x[ok]) + shift, -_HELD, _HELD).astype(np.int64)
    return found[d] if d else found


def merged_sums(partial: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{row: (high, low)} of partial (row, high, low), merged in two steps."""

    def run(iterator):
        held = {}
        for batch in iterator:
            for row, high, low in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                now = np.asarray(high.values), np.asarray(low.values)
                held[row] = add_pairs(held[row], now) if row in held else now
        rows = sorted(held)
        kinds = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([held[r][0] for r in rows], kinds), pa.array([held[r][1] for r in rows], kinds)], ["row", "high", "low"])

    schema = "row int, high array<double>, low array<double>"
    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = partial.repartition(n, "row", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(run, schema)
    second = first.repartition(n, "row").mapInArrow(run, schema)
    return {r["row"]: (np.array(r["high"]), np.array(r["low"])) for r in second.collect()}  # one row for each of d


def covariance(rows: DataFrame, d: int, entries) -> tuple[np.ndarray, np.ndarray]:
    """The d x d sums of products in double-double; entries(batch) gives the centred high and low parts of a batch."""
    i, j = np.triu_indices(d)
    ends = np.cumsum(np.arange(d, 0, -1))

    def run(iterator):
        total = None
        for batch in iterator:
            if batch.num_rows:
                found = outer_sums(*entries(batch), i, j)
                total = found if total is None else add_pairs(total, found)
        if total is not None:
            parts = [np.split(t, ends[:-1]) for t in total]
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(p, kinds) for p in parts)], ["row", "high", "low"])

    merged = merged_sums(rows.mapInArrow(run, "row int, high array<double>, low array<double>"))
    out = np.zeros((d, d)), np.zeros((d, d))
    for r, parts in merged.items():
        for matrix, part in zip(out, parts, strict=True):
            matrix[r, r:] = matrix[r:, r] = part
    return out


@dataclass
class Whitening:
    """What the fit found: d, n, sums S, covariance V of x, its eigenvalues e by falling size and eigenvectors as columns, and the whitened vectors' largest distance from the identity."""

    d: int
    n: int
    sums: list[int]
    v: np.ndarray
    e: np.ndarray
    vectors: np.ndarray
    identity_error: float
    scale: int
    shift: int

    def usable(self) -> np.ndarray:
        return self.e > 1e-14 * max(self.e[0], 0.0)


def centred(x: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n in double-double. x - floor(S/n) is a whole number; the rest of S/n is a fraction below 1, given in two parts."""
    floor = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    high = np.array([r / n for r in rest])
    # r - high * n as whole numbers: what the high part of the fraction leaves.
    low = np.array([_left(r, n, h) for r, h in zip(rest, high.tolist(), strict=True)])
    z, e = two_sum((x - floor).astype(np.float64), -high)
    return two_sum(z, e - low)


def _left(r: int, n: int, high: float) -> float:
    a, b = high.as_integer_ratio()
    return (r * b - a * n) / (n * b)


def fit(rows: DataFrame, vector_col: str, components: int, scale: int, shift: int) -> Whitening | None:
    """The whitening of all usable vectors; None where there are none."""
    vectors = rows.select(F.col(vector_col).alias("v"))

    def sums(iterator):
        held: dict[int, list] = {}
        for batch in iterator:
            for d, (found, x) in whole_entries(batch.column(0), None, scale, shift).items():
                n, total = held.get(d, (0, [0] * d))
                # In blocks of 1024 rows the 64 bits hold.
                for at in range(0, len(x), 1024):
                    total = [a + b for a, b in zip(total, x[at : at + 1024].sum(axis=0).tolist(), strict=True)]
                held[d] = n + len(found), total
        flat = [(d, k, n, str(s)) for d, (n, total) in held.items() for k, s in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["d", "k", "n", "s"])

    parts = vectors.mapInArrow(sums, "d int, k int, n long, s string").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # Of each length one row; of the chosen one d rows.
    best = parts.where("k = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d, n = best["d"], best["n"]
    total = [int(r["s"]) for r in parts.where(F.col("d") == d).orderBy("k").collect()]
    high, low = covariance(vectors, d, lambda batch: centred(whole_entries(batch.column(0), d, scale, shift)[1], total, n))
    v = (high + low) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    model = Whitening(d, n, total, v, e, u, 0.0, scale, shift)
    k = int(min(components, model.usable().sum()))
    if k:

        def whitened(batch):
            w = whitened_rows(whole_entries(batch.column(0), d, scale, shift)[1], model, k)
            return w, np.zeros_like(w)

        high, low = covariance(vectors, k, whitened)
        model.identity_error = float(np.abs((high + low) / n - np.eye(k)).max())
    return model


def whitened_rows(x: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """The first components of each row; their mean is 0 to rounding."""
    z, low = centred(x, model.sums, model.n)
    basis = model.vectors[:, :components] / np.sqrt(model.e[:components])
    return z @ basis + low @ basis


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """sum over dimensions of (n * x - S)^2, exactly."""
    floor = np.array([s // model.n for s in model.sums], np.int64)
    rest = [s % model.n for s in model.sums]
    off = x - floor
    if np.abs(off).max(initial=0).astype(float) * model.n < 2**62 and ((np.abs(off).max(initial=0).astype(float) + 1) * model.n) ** 2 * model.d < 2**62:
        y = off * model.n - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((a * model.n - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in off.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def apply(rows: DataFrame, model: Whitening, id_col: str, vector_col: str, components: int) -> DataFrame:
    """id, deviation, whitened (an array of the first components) of every usable vector."""
    k = min(components, model.d)
    ok = int(min(k, model.usable().sum()))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(iterator):
        for batch in iterator:
            found, x = whole_entries(batch.column(1), model.d, model.scale, model.shift)
            if not len(found):
                continue
            w = np.full((len(x), k), np.nan)
            w[:, :ok] = whitened_rows(x, model, ok)
            flat = pa.array(w.ravel(), from_pandas=True)  # what isn't defined is null
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)), pa.array(deviations(x, model), pa.int64()), whitened], ["id", "deviation", "whitened"])

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Whitening | None]:
    """(id, deviation, whitened) of every usable vector, and the fit; None and no rows without usable vectors."""
    with arrow_rows(rows.sparkSession, 4000):
        model = fit(rows, vector_col, components, scale, shift)
    if model is None:
        empty = rows.select(F.col(id_col).alias("id"), F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
        return empty, None
    return apply(rows, model, id_col, vector_col, components), model


def whitened_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each usable vector and component: id, component (from 1), n, deviation, whitened, explained (the eigenvalue's share of the trace), identity_error."""
    found, model = whiten(rows, id_col, vector_col, components)
    one = found.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    trace = float(np.trace(model.v)) if model else 0.0
    shares = [float(e) / trace if trace > 0 else 0.0 for e in (model.e[:components] if model else [])]
    explained = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("k"))
    return one.select(
        id_col, (F.col("k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error")
    )
