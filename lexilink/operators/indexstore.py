"""Vector indexes on disk: built once, opened by others, searched in blocks of queries.

An index is a folder: `vectors` holds every vector with its cell and its code, in the order of cells, `cells` the centroids of the cells, and `trained` one row with the settings, the coarse centroids, the codebooks
and the rotation. `trained` is written last, so an index is whole when it can be read. Kinds: flat; ivf: inverted cells (cells.py: trained in jobs, in two levels); pq: product-quantised codes; ivfpq: codes of what is left of vectors
less their coarse centroid; with `opq` codes are made after a rotation that makes their parts more independent. Codebooks and rotation are trained on at most `sample` vectors; every vector is indexed.

Search streams the stored vectors: a task meets only the queries that probe a row's cell, scores its codes, and keeps the best rows of each query; the best `refine` times k (8, or as many as the recall asks for) are
scored again by their exact vectors. Blocks of queries are small enough that their probes take 64 MB at most.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilink.operators import cells as K
from lexilink.operators import retrieval as R
from lexilink.operators.runs import delete, scratch

KINDS = ("flat", "ivf", "pq", "ivfpq")


@dataclass
class Trained:
    """Settings and what was trained: centers (of coarse cells, x d), codebooks (codes x entries x d / codes), rotation (d x d)."""

    kind: str
    metric: str
    size: int
    probes: int
    n_cells: int
    factory: str
    refine: int
    centers: np.ndarray = field(repr=False)
    books: np.ndarray = field(repr=False)
    rotation: np.ndarray = field(repr=False)

    def rest(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """What is coded: the rotated difference from the centroid of the coarse cell."""
        return (x - self.centers[cells] if len(self.centers) else x) @ self.rotation

    def codes_of(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return encoded(self.rest(x, cells), self.books)

    def decoded(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        parts = np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], axis=1)
        back = parts @ self.rotation.T
        return back + self.centers[cells] if len(self.centers) else back


def encoded(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest entry of each book, per part of each row."""
    width = books.shape[2]
    parts = [x[:, m * width : (m + 1) * width] for m in range(len(books))]
    return np.stack([(p @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)


def train(known: Trained, x: np.ndarray, own: np.ndarray, codes: int, bits: int, opq: bool, turns: int = 6) -> Trained:
    """known with codebooks and rotation for vectors x and their coarse cells."""
    d = x.shape[1]
    if d % codes:
        raise ValueError(f"{codes} codes don't divide {d} dimensions")

    def books_of(rest: np.ndarray) -> np.ndarray:
        found = [K.k_means_local(part, 1 << bits) for part in np.split(rest, codes, axis=1)]
        return np.stack([np.pad(b, ((0, (1 << bits) - len(b)), (0, 0)), mode="edge") for b in found])

    for _ in range(turns if opq else 1):
        rest = known.rest(x, own)
        known.books = books_of(rest)
        if opq:
            # The rotation that brings the vectors closest to what their codes stand for.
            parts = np.concatenate([known.books[m][c] for m, c in enumerate(encoded(rest, known.books).T)], axis=1)
            u, _, v = np.linalg.svd((x - known.centers[own] if len(known.centers) else x).T @ parts)
            known.rotation = u @ v
    return known


_VECTORS = "uid long, embedding array<float>, cell long, coarse long, code binary"


def _placed(rows: DataFrame, known: Trained, cells: K.Cells | None) -> DataFrame:
    """rows (uid, embedding) with their cells and codes."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    zero = F.lit(0).cast("long")
    in_cells = K.nearest_cells(rows, cells, "uid") if cells else rows.select("uid", zero.alias("cell"), zero.alias("coarse"), "embedding")

    def run(iterator):
        t = shared.value
        for batch in iterator:
            if batch.num_rows:
                coded = [c.tobytes() for c in t.codes_of(R._matrix(batch.column(3)), batch.column(2).to_numpy(zero_copy_only=False))] if len(t.books) else [b""] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), batch.column(2), pa.array(coded, pa.binary())], ["uid", "embedding", "cell", "coarse", "code"])

    return in_cells.select("uid", "cell", "coarse", "embedding").mapInArrow(run, _VECTORS)


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("uid").cast("long").alias("uid"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())


@dataclass
class VectorIndex:
    """more: folders of vectors that came after the index was built."""

    spark: SparkSession
    path: str
    trained: Trained
    more: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        """The index in a folder, None if there is none that is whole."""
        try:
            row = spark.read.parquet(f"{path}/trained").first().asDict()
        except (AnalysisException, Py4JJavaError):
            return None
        d, books = row["size"], np.array(row["books"])
        shaped = {"centers": np.array(row["centers"]).reshape(-1, d), "books": books.reshape(row["codes"], -1, d // max(1, row["codes"])) if len(books) else np.zeros((0, 0, 0)), "rotation": np.array(row["rotation"]).reshape(d, d)}
        return cls(spark, path, Trained(**{k: row[k] for k in ("kind", "metric", "size", "probes", "n_cells", "factory", "refine")}, **shaped))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, kind: str = "ivf", metric: str = "ip", factor: float = 1.0, codes: int = 16, bits: int = 8, opq: bool = False, sample: int = 50_000, overwrite: bool = False, files: int | None = None, recall: float | None = None) -> VectorIndex:
        """The index of (uid, embedding) in `path`: the one that is there, unless `overwrite`. With `recall` an index of cells probes as many of them, and one of codes refines as many of their candidates, as find this share of the ten nearest (see _reach), and no fewer than by `factor`."""
        spark = vectors.sparkSession
        if kind not in KINDS or metric not in R.METRICS:
            raise ValueError(f"{kind} index by {metric}: none of {KINDS} by {R.METRICS}")
        if not overwrite and (found := cls.open(spark, path)) is not None:
            return found
        rows = _plain(vectors)
        n = rows.count()
        count, probes = R.ivf_parameters(n, factor)
        delete(spark, f"{path}/trained")
        found = K.train_cells(rows, count, f"{path}/cells") if kind.startswith("ivf") and n else None
        x = R.sampled_vectors(rows, sample) if kind.endswith("pq") and n else np.zeros((0, 0))
        d = x.shape[1] or (found.coarse.shape[1] if found else 0) or (rows.agg(F.max(F.size("embedding"))).first()[0] if n else 0)
        known = Trained(kind, metric, d, probes, found.n_fine if found else 0, R.factory_string(kind, n, codes, bits, opq), 8, found.coarse if found else np.zeros((0, d)), np.zeros((0, 0, 0)), np.eye(d))
        if len(x):
            known = train(known, x, K.nearest(x, known.centers) if found else np.zeros(len(x), np.int64), codes, bits, opq)
        placed = _placed(rows, known, found)
        # Hashes of the ids split cells that are large, so that no range of cells is one task's.
        ranged = placed.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.xxhash64("uid")).sortWithinPartitions("cell", "uid")
        ranged.write.mode("overwrite").parquet(f"{path}/vectors")
        if recall is not None and n and kind != "flat":
            cls(spark, path, known)._reach(recall)
        flat = {k: v for k, v in asdict(known).items() if not isinstance(v, np.ndarray)} | {k: getattr(known, k).ravel().tolist() for k in ("centers", "books", "rotation")} | {"codes": len(known.books)}
        schema = "kind string, metric string, size int, probes int, n_cells long, factory string, refine int, centers array<double>, books array<double>, rotation array<double>, codes int"
        spark.createDataFrame([[flat[c.split()[0]] for c in schema.split(", ")]], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trained")
        return cls(spark, path, known)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors", *self.more)

    def place(self, vectors: DataFrame, path: str) -> None:
        """Writes more vectors, in the index's cells and codes, to a folder of their own."""
        _placed(_plain(vectors), self.trained, self.cells() if self.trained.n_cells else None).write.mode("overwrite").parquet(path)

    def cells(self) -> K.Cells:
        fine = self.spark.read.schema("cell long, coarse long, center array<double>").parquet(f"{self.path}/cells")
        return K.Cells(self.trained.centers, fine, self.trained.n_cells)

    def _reach(self, recall: float, k: int = 10, sample: int = 500) -> None:
        """Raises probes and refine until a share of the k nearest others of some stored vectors, those with the smallest hashes of their ids, is found: exact search says which they are. Where there are cells and codes, each may lose half of what may be lost."""
        t = self.trained
        some = self.vectors().select(F.col("uid").alias("mention"), "embedding").orderBy(K.place("mention", 3), "mention").limit(sample).toArrow()
        queries = self.spark.createDataFrame(some)
        true = R.knn(queries, self.vectors(), k + 1, t.metric).where("mention <> uid").join(self.vectors().select("uid", "cell"), "uid").select("mention", "uid", "cell").toArrow()
        true = self.spark.createDataFrame(true)
        if t.n_cells:
            t.probes = max(t.probes, self._probes_for(math.sqrt(recall) if len(t.books) else recall, queries, true))
        wanted, stored = true.count(), self.vectors().count()
        # Codes of more and more vectors tell less and less apart.
        while len(t.books) and t.refine * k < stored and self.search(queries, k + 1).join(true, ["mention", "uid"]).count() < recall * wanted:
            t.refine *= 2

    def _probes_for(self, recall: float, queries: DataFrame, true: DataFrame) -> int:
        """How many cells must be probed to hold a share of the true (mention, uid, cell): the places of their cells among each vector's nearest cells say how far one must look."""
        by_place = K.nearest_cells(queries, self.cells(), "mention", self.trained.n_cells, len(self.trained.centers)).select("mention", "cell", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("near"), "cell")).alias("place"))
        far = np.sort(true.join(by_place, ["mention", "cell"]).select("place").toArrow().column(0).to_numpy())
        return int(far[min(len(far) - 1, math.ceil(recall * len(far)))]) if len(far) else 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None) -> DataFrame:
        """(mention, rank, uid, score) of the k best for each (mention, embedding); fewer where the probed cells hold fewer."""
        t = self.trained
        if t.kind == "flat":
            return R.knn(queries, self.vectors(), k, t.metric)
        most = k * (refine or t.refine) if len(t.books) else k
        parts = None
        probes = min(probes or t.probes, max(1, t.n_cells))
        for ids, q in R.query_blocks(queries, min(200_000, max(1, (4 << 20) // probes))):
            part = self._partial(ids, q, most, probes)
            parts = part if parts is None else parts.unionByName(part)
        best = R.merge_top_k(parts, most)
        if not len(t.books):
            return best
        rows = best.select("mention", "uid").join(self.vectors().select("uid", "embedding"), "uid").join(queries.select("mention", F.col("embedding").alias("query")), "mention")
        each = F.zip_with("query", "embedding", (lambda a, b: a.cast("double") * b.cast("double")) if t.metric == "ip" else (lambda a, b: -(a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))
        return R.merge_top_k(rows.select("mention", "uid", F.round(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), R.DIGITS).alias("score")), k)

    def _partial(self, ids: np.ndarray, queries: np.ndarray, k: int, probes: int) -> DataFrame:
        """(mention, uid, score): each task's best rows among the cells that queries probe."""
        t = self.trained
        asked: dict[int, np.ndarray] = {0: np.arange(len(ids))}
        if t.n_cells and len(ids):
            block = self.spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(ids))), "embedding": K._lists(queries)}))
            # A few coarse cells more than hold as many cells as are probed.
            coarse = max(8, -(-4 * probes * len(t.centers) // t.n_cells))
            near = K.nearest_cells(block, self.cells(), "at", probes, coarse).select("at", "cell").toArrow()
            at, cell = near.column("at").to_numpy(), near.column("cell").to_numpy()
            order = np.lexsort((at, cell))  # a cell's queries ascend
            at, cell = at[order], cell[order]
            cuts = np.flatnonzero(np.diff(cell)) + 1
            asked = {int(cell[k[0]]): at[k] for k in np.split(np.arange(len(cell)), cuts) if len(k)}
        shared = self.spark.sparkContext.broadcast((t, ids, queries, asked))
        stored = self.vectors().select("uid", "cell", "code" if len(t.books) else "embedding", "coarse")
        if len(asked) <= 1000:
            stored = stored.where(F.col("cell").isin([*asked]))

        def run(iterator):
            t, ids, q, asked = shared.value
            borders = np.arange(R.QUERY_BLOCK, len(ids), R.QUERY_BLOCK)
            tops = [R.RunningTop(k) for _ in range(len(borders) + 1)]
            for batch in iterator:
                if not batch.num_rows or not len(ids):
                    continue
                uids, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                order = np.argsort(cells, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                    who = asked.get(int(cells[rows[0]]))
                    if who is None:
                        continue
                    if len(t.books):
                        codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                        x = t.decoded(codes, batch.column(3).to_numpy(zero_copy_only=False)[rows])
                    else:
                        x = R._matrix(batch.column(2).take(pa.array(rows)))
                    for top, some in zip(tops, np.split(who, np.searchsorted(who, borders)), strict=True):
                        if len(some):
                            R.add_best(top, some, q[some], uids[rows], x, t.metric)
            for top in tops:
                yield pa.RecordBatch.from_arrays([pa.array(ids[top.rows], pa.int64()), pa.array(top.uids), pa.array(top.scores)], ["mention", "uid", "score"])

        return stored.mapInArrow(run, "mention long, uid long, score double")


def knn_ivf(queries: DataFrame, index: DataFrame, k: int, factor: float = 1.0, recall: float | None = None) -> DataFrame:
    """Approximate top-k over an index made for this one search."""
    path = f"{scratch(index.sparkSession)}/ivf-{uuid.uuid4().hex}"
    return VectorIndex.build(index, path, "ivf", factor=factor, recall=recall).search(queries, k)
