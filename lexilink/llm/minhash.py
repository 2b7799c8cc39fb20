"""Near-duplicate detection by SuperMinHash signatures, bands, exact verification and union-find grouping.

1. A document is its set of distinct word shingles (jaccard.py makes them). Its signature has m places. Each shingle, seeded by its hash, walks through a random permutation of the places and
   writes step + (a random fraction) to the place of each step; a place keeps the least value. Since a shingle's steps fall on different places, signatures of small sets vary less than those of
   independent hashes. A set whose places all hold a value is done: later steps write larger values only. So long sets end after a step or two.
2. Bands of `rows` places are hashed to keys, as many rows as leave at most one linked pair in 10^8 without a common key (for 0.85 and m = 256: 42 bands of 6 rows). Each task
   first joins its own documents of one key, and passes one row a key on; a key that very many documents have is then a row for each batch of documents, not for each document. What shares a key is
   connected with the first document of the key: groups are never listed as pairs.
3. Documents connected that way are candidates. Each connected group is compared on whole sets (jaccard.py: pivots against an inverted index in small groups, regions of pivots in large ones), so every link is confirmed and
   groups of candidates that aren't linked fall apart again. Union-find over the links gives the classes.

Documents with equal sets (by a 128-bit digest) are one from step 2 on.

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing; a text of fewer than n words is one shingle; rows are told apart even where they repeat an id (component_id is the smallest id
among a class's rows, null only if all are null; `kept` is true for all rows that have it); an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import Scratch, arrow_rows, give_back, written
from lexilink.llm.components import forest, forest_stream
from lexilink.llm.jaccard import classes_of_candidates, equal_sets, set_table, sets_of, slices

_STEP = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], m: int = 256) -> np.ndarray:
    """The SuperMinHash signature of each set: a value is (step << 32 | fraction). m is at most 256; empty sets have no values."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64)
    out = np.full(len(sets) * m, _NONE, np.uint64)
    places = None  # the part of each shingle's permutation that is still to come
    for step in range(m):
        if not len(seeds):
            break
        drawn = wb.mix(seeds + np.uint64((step + 1) * _STEP % (1 << 64)))
        at = (((drawn >> np.uint64(32)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64) + step
        if places is None:
            place = at
        else:
            rows = np.arange(len(seeds))
            place = places[rows, at].astype(np.int64)
            places[rows, at] = places[rows, step]
        np.minimum.at(out, owner * m + place, (np.uint64(step) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF)))
        unfinished = (out.reshape(-1, m) == _NONE).any(axis=1)[owner]
        left = int(unfinished.sum())
        if left == 0:
            break
        if left < 0.75 * len(seeds) or places is None:
            seeds, owner = seeds[unfinished], owner[unfinished]
            if places is None:
                places = np.tile(np.arange(m, dtype=np.uint8), (left, 1))
                places[np.arange(left), at[unfinished]] = 0
            else:
                places = places[unfinished]
    return out.reshape(-1, m)


def band_rows(percent: int, m: int, missed: float = 1e-8) -> int:
    """The most rows a band may have so that a pair of just this similarity has no band in common with at most the probability `missed`."""
    fits = [r for r in range(1, m + 1) if (1 - (percent / 100) ** r) ** (m // r) <= missed]
    return max(fits, default=1)


def band_keys(signed: np.ndarray, rows: int) -> np.ndarray:
    """The key of each band of each signature."""
    bands = signed.shape[1] // rows
    cut = signed[:, : bands * rows].reshape(len(signed), bands, rows)
    keys = np.broadcast_to(wb.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP)), cut.shape[:2])
    for k in range(rows):
        keys = wb.mix(keys + cut[:, :, k])
    return keys


def banded(sets: DataFrame, percent: int, m: int, held_docs: int = 4000, most_tokens: int = 1 << 17) -> DataFrame:
    """(key, rid, other): one row for each key and batch of held_docs documents, and (null, rid, other) for documents of a batch that share a key with others of it."""
    rows = band_rows(percent, m)

    def combined(keys: np.ndarray, rids: np.ndarray):
        flat, of = keys.ravel(), np.repeat(rids, keys.shape[1])
        order = np.lexsort((of, flat))
        flat, of = flat[order], of[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])
        head = of[np.flatnonzero(first)[np.cumsum(first) - 1]]
        apart = ~first & (of != head)
        a, b = forest(of[apart], head[apart])
        none = pa.nulls(len(a), pa.int64())
        names = ["key", "rid", "other"]
        yield pa.RecordBatch.from_arrays([pa.array(flat[first].view(np.int64)), pa.array(of[first]), pa.nulls(int(first.sum()), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([none, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    def run(iterator):
        keys, rids, docs = [], [], 0
        for batch in slices(iterator):
            sets, at = sets_of(batch.column(1)), 0
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            while at < len(sets):
                to, size = at, 0
                while to < len(sets) and (to == at or size + len(sets[to]) <= most_tokens):
                    size += len(sets[to])
                    to += 1
                keys.append(band_keys(signatures(sets[at:to], m), rows))
                rids.append(ids[at:to])
                docs, at = docs + to - at, to
            if docs >= held_docs:
                yield from combined(np.concatenate(keys), np.concatenate(rids))
                keys, rids, docs = [], [], 0
        if docs:
            yield from combined(np.concatenate(keys), np.concatenate(rids))
        keys = rids = None
        give_back()

    return sets.where("n > 0").select("rid", "tokens").mapInArrow(run, "key long, rid long, other long")


def key_links(bands: DataFrame) -> DataFrame:
    """(a, b): each document of a key with the key's first one, in a stream over sorted keys."""

    def run(iterator):
        last = None  # the key that may go on, and its first document
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys, rids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            heads = rids[starts].copy()
            if last is not None and keys[0] == last[0]:
                heads[0] = last[1]
            last = keys[-1], heads[-1]
            head = np.repeat(heads, np.diff(np.append(starts, len(keys))))
            apart = rids != head
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(rids[apart]), pa.array(head[apart])], ["a", "b"])

    return bands.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(lambda rows: forest_stream(run(rows)), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, m: int = 256, id_col: str = "doc_id", text_col: str = "text", cell_tokens: int = 1_500_000) -> DataFrame:
    """id, n_shingles, component_id and kept of each row of docs: the class's smallest id, and whether it is the row's own. Written to the shared folder."""
    with arrow_rows(docs.sparkSession, 2000), Scratch(docs.sparkSession) as scratch:
        sets = set_table(docs, n, id_col, text_col, scratch)
        copies = equal_sets(sets, scratch)
        bands = scratch.written(banded(sets, percent, m), "bands")
        found = bands.where("key IS NULL").select(F.col("rid").alias("a"), F.col("other").alias("b")).unionByName(key_links(bands.where("key IS NOT NULL").select("key", "rid")))
        edges = scratch.written(found, "candidate-edges")
        scratch.drop(bands)
        classes = classes_of_candidates(edges, sets, copies, percent, cell_tokens, scratch)
        out = classes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
        return written(out, "near-duplicates")
