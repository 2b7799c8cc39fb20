"""The encoder seam: any function from texts to vectors, run over Arrow batches; and a projection head with given weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int) -> Encoder:
    """Unit vectors of signed hashed words: a stand-in that needs no weights."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def letter_encoder(dim: int) -> Encoder:
    """Unit vectors of the counts of characters by their code modulo dim: one that SQL can say too."""

    def run(texts: list[str]) -> np.ndarray:
        codes = [[ord(c) % dim for c in (t or "").lower()] for t in texts]
        out = np.stack([np.bincount(c, minlength=dim) for c in codes]).astype(np.float64) if codes else np.zeros((0, dim))
        return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-12)

    return run


def _lists(x: np.ndarray, kind=np.float32) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, kind).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encoder, batch: int = 2048, keep: Sequence[str] = ()) -> DataFrame:
    """(id, embedding) of each row's text, and the columns to keep."""

    def run(iterator):
        for rows in iterator:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(encoder(part.column(1).to_pylist())), *part.columns[2:]], [id_col, "embedding", *keep])

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(id_col).cast("long"), text_col, *keep).mapInArrow(run, f"{id_col} long, embedding array<float>{kept}")


@dataclass
class Projection:
    """LayerNorm, linear map, LayerNorm."""

    weight: np.ndarray
    bias: np.ndarray

    @classmethod
    def seeded(cls, size: int, out: int, seed: int = 0) -> Projection:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, size**-0.5, (size, out)), np.zeros(out))

    @classmethod
    def stepped(cls, size: int, out: int) -> Projection:
        """Small weights by rule, for comparisons."""
        i, j = np.indices((size, out))
        return cls(((i * 7 + j * 13) % 11 - 5) / 10, np.zeros(out))

    @staticmethod
    def normalise(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.normalise(self.normalise(x) @ self.weight + self.bias)


def project(df: DataFrame, id_col: str, column: str, head: Projection) -> DataFrame:
    def run(iterator):
        for rows in iterator:
            if rows.num_rows:
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(head(x), np.float64)], [id_col, column])

    return df.select(F.col(id_col).cast("long"), column).where(F.col(column).isNotNull()).mapInArrow(run, f"{id_col} long, {column} array<double>")
