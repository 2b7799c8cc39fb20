"""Variable-capacity best-fit packing of documents into training sequences.

A document is its token ids and an end id, from the encoder of the token files. Documents are taken in descending length. Each goes to the open bin with the least room that still fits it; if there is none, a bin is opened, of the permitted
capacity with the least cost per token that it can be expected to hold: a bin costs its capacity plus `overhead`, and what it can hold beyond the document is limited by the
tokens that are still to come less the room already open. At the end each bin shrinks to the least capacity that holds its contents. A group of documents is packed with every choice of the permitted capacities that has
the largest one needed, and the choice of the least total cost stays, so capacities are decided on jointly, not bin by bin alone. Documents longer than the largest capacity are cut
into pieces of it and a rest, and all pieces are packed, so no token is lost.

Bins are decided on by ids and lengths alone. These are dealt into groups of about `group_items` by a hash of id and text, rows that repeat both by their number among the equal ones, so copies spread, and the result hangs on the rows alone,
not on their partitions. Each group is packed on its own, in one task with bounded memory; what this costs is at most the open bins at each group's end. Then every piece gets its token ids, and `sequences` fills bins with them; a bin is bounded by its capacity.

Edge cases: a null or empty text has its end token alone; ties are packed by id, null ids first, then by the text's hash; rows that repeat an id are packed each for itself, told apart by `mark` (the text's hash) and `copy` (the number among rows
that repeat both, from 0); an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import arrow_rows, give_back, written
from lexilink.llm.tokenfiles import Encoder

CAPACITIES = (1024, 2048, 4096)
OVERHEAD = 64


def open_capacity(length: int, to_come: int, room: int, capacities: tuple[int, ...], overhead: int) -> int:
    """Where opening costs least per token; to_come: tokens after this document, room: what open bins can still take."""
    spare = max(0, to_come - room)
    return min((c for c in capacities if c >= length), key=lambda c: ((c + overhead) / min(c, length + spare), c))


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item, and the capacity of each bin; lengths descend and are at most the largest capacity."""
    capacities = tuple(sorted(capacities))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    by_room: dict[int, list[int]] = {}  # bins by room, the latest last
    rooms: list[int] = []
    to_come, room = sum(lengths), 0
    for k, length in enumerate(lengths):
        to_come -= length
        at = bisect_left(rooms, length)
        if at < len(rooms):
            free = rooms[at]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free], rooms[at]
            room -= length
        else:
            free = open_capacity(length, to_come, room, capacities, overhead)
            b = len(used)
            used.append(0)
            room += free - length
        bins[k], offsets[k] = b, used[b]
        used[b] += length
        left = free - length
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets, np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)


def cost(sizes: np.ndarray, overhead: int) -> int:
    return int(sizes.sum()) + overhead * len(sizes)


def pack_jointly(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack gives for the choice of capacities of the least total cost, of equal ones the first of the fewest; bins shrink to any permitted capacity."""
    capacities = tuple(sorted(capacities))
    best = None
    for k in range(1, len(capacities) + 1):
        for chosen in combinations(capacities, k):
            if not lengths or chosen[-1] >= lengths[0]:
                bins, offsets, sizes = pack(lengths, chosen, overhead)
                used = np.bincount(bins, lengths, len(sizes)).astype(np.int64) if len(sizes) else sizes
                sizes = np.array(capacities)[np.searchsorted(capacities, used)] if len(sizes) else sizes
                if best is None or cost(sizes, overhead) < cost(best[2], overhead):
                    best = bins, offsets, sizes
    return best


def token_lengths(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, id, mark, length) and on request `ids` (little-endian unsigned 32-bit integers) of each row of docs, as a written table, so that row numbers stay what they are."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, mark long, length long" + (", ids binary" if with_ids else "")

    def run(iterator):
        encoder = Encoder.at(tokenizer_path, end_id)
        give_back()  # what reading the vocabulary took
        for batch in wb.batches(iterator, "text"):
            ids, counts = encoder.encode(batch.column(3))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                columns.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]))
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "mark", "length", "ids"][: len(columns)])
        give_back()

    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    with arrow_rows(spark, 1000):
        return written(plain.mapInArrow(run, schema), "token-lengths")


def numbered_copies(items: DataFrame) -> DataFrame:
    """items with `copy`: the number of a row among those with its id and mark, from 0. Rows of a partition are numbered there, and then shifted by the sizes of the partitions before it, so no key meets in one task."""
    same = ["id", "mark"]
    again = items.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
    known = items.join(again, items["id"].eqNullSafe(again["_id"]) & (items["mark"] == again["_mark"]), "left").withColumn("part", F.shiftright("row", 33))
    once = known.where("_mark IS NULL").select(*items.columns, F.lit(0).cast("long").alias("copy"))
    rest = known.where("_mark IS NOT NULL").withColumn("inside", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1)
    sizes = rest.groupBy(*same, "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(c).alias(f"of_{c}") for c in (*same, "part")], before.alias("before"))
    met = rest.join(shifts, rest["id"].eqNullSafe(shifts["of_id"]) & (rest["mark"] == shifts["of_mark"]) & (rest["part"] == shifts["of_part"]))
    return once.unionByName(met.select(*items.columns, (F.col("before") + F.col("inside")).alias("copy")))


def pack_lengths(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_items: int = 50_000) -> DataFrame:
    """bin_id, capacity, row, id, mark, copy, start (of the piece in its document), n_tokens, offset (in the bin) for (row, id, mark, length) rows, a table that gives the same rows each time it is read."""
    largest = max(capacities)
    kind = items.schema["id"].dataType.simpleString()
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(largest).cast("long"))
    own = ["row", "id", "mark", "copy"]
    pieces = numbered_copies(items.select("row", "id", "mark", "length").where("length > 0")).select(*own, "length", F.explode(starts).alias("start")).select(*own, "start", F.least(F.col("length") - F.col("start"), F.lit(largest).cast("long")).alias("n_tokens"))
    n = items.where("length > 0").agg(F.sum(F.ceil(F.col("length") / largest))).first()[0] or 0
    groups = max(1, -(-n // group_items))
    # A long document's pieces fall in different groups, and so do copies.
    dealt = pieces.withColumn("group", F.pmod(F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 40)) + F.col("copy") + F.floor(F.col("start") / largest), F.lit(groups)).cast("int"))

    def run(iterator):
        group, held = None, []

        def out():
            *known, start, tokens = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in range(6))
            bins, offsets, size = pack_jointly(tokens.to_pylist(), capacities, overhead)
            return pa.RecordBatch.from_arrays(
                [pa.array((np.int64(group) << 32) + bins), pa.array(size[bins].astype(np.int64)), *known, start, tokens, pa.array(offsets)], ["bin_id", "capacity", *own, "start", "n_tokens", "offset"]
            )

        for batch in iterator:
            groups_of = batch.column(6).to_numpy()
            cuts = [0, *(np.flatnonzero(groups_of[1:] != groups_of[:-1]) + 1).tolist(), len(groups_of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if group is not None and groups_of[a] != group:
                    yield out()
                    held = []
                group = int(groups_of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield out()
        held = []
        give_back()

    ordered = dealt.select(*own, "start", "n_tokens", "group").repartition("group").sortWithinPartitions("group", F.desc("n_tokens"), "id", "mark", "copy", "start")
    return ordered.mapInArrow(run, f"bin_id long, capacity long, row long, id {kind}, mark long, copy long, start long, n_tokens long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Where each piece of each document goes, and what it is: bin_id, capacity, id, mark, copy, start, n_tokens, offset, ids (the piece's token ids as little-endian unsigned 32-bit integers). Reads two tables in the shared folder."""
    tokens = token_lengths(docs, tokenizer_path, end_id, id_col, text_col, with_ids=True)
    placed = written(pack_lengths(tokens.drop("ids"), **options), "placements")
    return with_ids(placed, tokens).drop("row").withColumnRenamed("id", id_col)


def with_ids(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pieces with their token ids."""
    return placed.join(tokens.select("row", "ids"), "row").withColumn("ids", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("n_tokens")).cast("int")))


def sequences(pieces: DataFrame) -> DataFrame:
    """bin_id, capacity, ids (as in the pieces, one after another), pieces (id, start, offset, n_tokens): the bins with their contents, from pieces with ids."""
    bins = pieces.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "start", "n_tokens", "ids"))).alias("p"))
    return bins.select("bin_id", "capacity", F.aggregate("p", F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"])).alias("ids"), F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), p["offset"].alias("offset"), p["n_tokens"].alias("n_tokens"))).alias("pieces"))


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Training sequences of docs: bin_id, capacity, ids (at most capacity, as little-endian unsigned 32-bit integers), pieces."""
    return sequences(pack_documents(docs, tokenizer_path, end_id, id_col, text_col, **options).withColumnRenamed(id_col, "id"))
