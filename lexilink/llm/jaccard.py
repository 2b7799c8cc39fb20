"""Exact n-gram Jaccard join over pivots, and the classes of linked documents.

A document is its set of distinct word shingles (as 64-bit hashes); d = 1 - J is a metric. Nearly all pairs of documents have d = 1, so whole documents as first
pivots would tell nothing apart and their windows would replicate everything. The space is therefore cut in three steps, each exact for d <= r:

1. Ground pivots are single shingles. A document's own shingles are its nearest pivots (d({s}, x) = 1 - 1/|x|, ties broken by rarity, then hash), and its Voronoi
   regions are those of its first |x| - ceil(t|x|) + 1 pivots: two documents with J >= t share a region, since fewer shared shingles than that are left.
   Sharing more than one of their first pivots is asked for where sizes imply it: of pairs in small regions only those with as many shared regions as a link needs go on.
2. In a region documents are points of pivot counts |x & H_j| for classes H_j of the shingles, 256 of them, and more for large sets, whose counts would else differ by chance no more than those
   of linked ones (`SIZES`; linked sets are near in size, so pairs of one range of sizes are tested apart). By the triangle inequality of the symmetric difference, linked documents differ
   there by at most (1 - t) / (1 + t) * (|x| + |y|) in sum. Small regions test all their points this way; in large ones leaders take up the points within a radius,
   and later points are compared with leaders only, in windows widened by that radius; the largest are dealt to several tasks, whose leaders meet afterwards. What passes is connected to cells, which hold every link.
3. Cells are joined exactly on whole sets, with documents as pivots, for here distances do tell something. A cell with more than `cell_tokens` shingles gets pivots drawn from its own
   documents, each of which is compared with the whole cell. A document belongs to the Voronoi region of its nearest pivot p, and to that of every pivot q with d(x, q) <= d(x, p) + 2r: by the triangle inequality, documents
   within r of each other meet in the region of either; documents far from all pivots meet in a region of their own. All documents within r of q are of one class already, so of those a region keeps only the ones that may be within r of a document
   that isn't, by distance from q. Regions that are still too large get pivots of their own, and so on; a cell that its pivots don't divide is cut in blocks that meet in pairs.
   Small cells are joined at once: pivots against the cell through an inverted index, first a few, then all that aren't in the
   largest class yet, so that groups of thousands of near copies need no comparison within the class they have.

Sets that are equal count once (by a 128-bit digest). Frequent shingles, found by counts over all sets, come last in the order of pivots, so hot passages
seldom open a region; the order has no influence on results.

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing; a text of fewer than n words is one shingle; rows are told apart even where they repeat an id
(component_id is the smallest id among a class's rows, null only if all are null); an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import Scratch, arrow_rows, beside, free_name, give_back, written
from lexilink.llm.components import UnionFind, components, forest_stream

#: Sets of at most so many shingles, and the number of classes, a power of two, that their points have.
SIZES = ((2000, 256), (32_000, 4096), (1 << 62, 65_536))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = wb.text_bytes(column)
    starts, ends, bounds = wb.word_spans(data, offsets)
    words = wb.spans_hash(data, starts, ends)
    windows = wb.shingle_hash(words, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(windows[a : b - n + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = wb.mix(wb.shingle_hash(words[a:b], b - a) + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def counts_by_class(sets: list[np.ndarray], buckets: int = SIZES[0][1]) -> np.ndarray:
    """|x & H_j| of each set, saturated at 255."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = (tokens >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    flat = np.bincount(owner * buckets + of, minlength=len(sets) * buckets)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, buckets)


#: Beyond this distance from all pivots a document is in none of their regions for its own sake.
FAR = 0.6


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def packed(counts) -> pa.Array:
    """Points as they are written and shuffled: small counts take two bits rather than eight."""
    return _binary([pa.compress(c, "zstd", asbytes=True) for c in counts])


def unpacked(column: pa.Array, buckets: int) -> np.ndarray:
    """The points of a column, one a row."""
    raw = b"".join(pa.decompress(c, buckets, "zstd", asbytes=True) for c in column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, buckets)


def point_rows(buckets: int) -> int:
    """How many points are unpacked at once: about 1 MB."""
    return max(16, (1 << 20) // buckets)


def sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), np.uint64) for b in column]


def slices(iterator, rows: int = 500):
    """Batches of few rows: Python objects are made of a few sets at a time."""
    for batch in iterator:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def set_table(docs: DataFrame, n: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """rid, id, mark (of the text), n, digest, tokens of every row, as a written table."""

    def run(iterator):
        for batch in wb.batches(iterator, "text", 1 << 20):
            sets = shingle_sets(batch.column(3), n)
            raw = [s.tobytes() for s in sets]
            digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), _binary(digests), _binary(raw)], ["rid", "id", "mark", "n", "digest", "tokens"])
        give_back()

    plain = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    return scratch.written(plain.mapInArrow(run, "rid long, id long, mark long, n long, digest binary, tokens binary"), "shingle-sets")


#: Bits of a map of rids, a power of two: 8 MB, however many rids there are.
MAP_BITS = 1 << 26


def _bit_place(bits: int):
    return F.pmod(F.xxhash64("rid"), F.lit(bits))


def rid_map(rids: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bit for the place of each rid, as bytes: what isn't in it is none of the rids, and few others are in it by chance."""
    place = _bit_place(bits)
    found = rids.groupBy(F.shiftright(place, 5).cast("int").alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod(place, F.lit(32))).cast("long")).alias("set")).toArrow()
    words = np.zeros(max(1, bits // 32), "<u4")
    words[found.column("word").to_numpy()] = found.column("set").to_numpy().astype("<u4")
    return words.view(np.uint8)


def points_of(sets: DataFrame, low: int, high: int, buckets: int, percent: int, paired: np.ndarray, met: np.ndarray) -> DataFrame:
    """(rid, n, counts, paired, met) of the sets that can be linked with one of over `low` and at most `high` shingles and are in one of two maps of rids, and which: of pairs, and of rows of large regions."""
    shared = sets.sparkSession.sparkContext.broadcast((paired, met))

    def run(iterator):
        for batch in slices(iterator, 200):
            at = batch.column(3).to_numpy(zero_copy_only=False)
            # Most documents are in no pair and in no large region: their points would be shuffled for nothing.
            of = [(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) for bits in shared.value]
            batch, of = batch.filter(pa.array(of[0] | of[1])), [x[of[0] | of[1]] for x in of]
            counts = counts_by_class(sets_of(batch.column(2)), buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(counts), *map(pa.array, of)], ["rid", "n", "counts", "paired", "met"])
        give_back()

    some = sets.where((F.col("n") > low * percent / 100) & (F.col("n") <= high) & (F.col("n") > 0))
    return some.select("rid", "n", "tokens", _bit_place(8 * len(met))).mapInArrow(run, "rid long, n long, counts binary, paired boolean, met boolean")


def frequent_tokens(sets: DataFrame, one_in: int = 1000, most: int = 1_000_000, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, counts) of shingles in at least about one_in documents' sets; at most `most` of them, the most frequent ones.

    A chunk of c tokens of m documents reports tokens that are in at least m / (2 one_in) of them, so reports are bounded by 2 one_in times the mean set size per chunk.
    """

    def run(iterator):
        held, size, docs = [], 0, 0

        def out():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            hot = counts >= max(4, docs / (2 * one_in))
            return pa.RecordBatch.from_arrays([pa.array(tokens[hot].view(np.int64)), pa.array(counts[hot])], ["token", "count"])

        for batch in slices(iterator):
            for s in sets_of(batch.column(0)):
                held.append(s)
                size, docs = size + len(s), docs + 1
                if size >= chunk:
                    yield out()
                    held, size, docs = [], 0, 0
        if size:
            yield out()
        held.clear()
        give_back()

    n = sets.count()
    found = sets.select("tokens").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    rows = found.where(F.col("count") >= n / one_in).orderBy(F.desc("count"), "token").limit(most).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["count"].to_numpy(np.int64)[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def nearest_pivots(s: np.ndarray, hot: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The shingles whose regions a set belongs to: rare ones by hash, then frequent ones by count."""
    k = prefix_length(len(s), percent)
    if not len(hot):
        return s[:k]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    cold = s[~is_hot]
    if len(cold) >= k:
        return cold[:k]
    warm, c = s[is_hot], count[at[is_hot]]
    return np.concatenate([cold, warm[np.lexsort((warm, c))][: k - len(cold)]])


def region_rows(sets: DataFrame, hot: np.ndarray, count: np.ndarray, percent: int) -> DataFrame:
    """(token, rid, n): the regions of one row per distinct set and task."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast((hot, count))

    def run(iterator):
        hot, count = shared.value
        seen = set()
        for batch in slices(iterator):
            tokens, rids, sizes = [], [], []
            for rid, digest, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2)), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    p = nearest_pivots(s, hot, count, percent)
                    tokens.append(p)
                    rids.append(np.full(len(p), rid, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(rids)), pa.array(np.concatenate(sizes))], ["token", "rid", "n"])
        give_back()

    return sets.where("n > 0").select("rid", "digest", "tokens").mapInArrow(run, "token long, rid long, n int")


def shared_regions(rows: DataFrame, percent: int, small: int = 8) -> DataFrame:
    """(token, a, b, n_a, n_b): of regions with at most `small` rows the pairs whose sizes allow a link; of larger ones the rows as a (b null) with another row of such a size.

    A stream over sorted rows that holds back at most `small` rows.
    """

    def run(iterator):
        held, large = None, None  # the last region so far, or the last row of a large one that goes on, and its token
        before = -1  # the size of the row before that row

        def out(token, a, b, n_a, n_b, pairs):
            return pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(a), pa.array(b, pa.int64()) if pairs else pa.nulls(len(a), pa.int64()), pa.array(n_a), pa.array(n_b, pa.int32()) if pairs else pa.nulls(len(a), pa.int32())],
                ["token", "a", "b", "n_a", "n_b"],
            )

        def pairs_of(tokens, rids, n, size):
            found = []
            for step in range(1, small):
                if len(tokens) > step:
                    i = np.flatnonzero((tokens[step:] == tokens[:-step]) & (size[step:] <= small) & (100 * n[:-step].astype(np.int64) >= percent * n[step:].astype(np.int64)))
                    found.append((i, i + step))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                yield out(tokens[i], rids[i], rids[j], n[i], n[j], True)

        def with_neighbour(tokens, n, before, large):
            """Rows whose sizes may be linked with those of the next smaller or the next larger row of their region, and so all that may be linked with any."""
            near = (tokens[1:] == tokens[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            first = large is not None and tokens[0] == large and 100 * int(before) >= percent * int(n[0])
            return np.concatenate([[first], near]) | np.concatenate([near, [False]])

        for batch in iterator:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            tokens, rids, n = now
            if not len(tokens):
                continue
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            sizes = np.diff(np.append(starts, len(tokens)))
            if large is not None and tokens[0] == large:
                sizes[0] = max(sizes[0], small + 1)
            met = with_neighbour(tokens, n, before, large)
            # The last region is whole only at the end; of one that is known to be large, the last row's neighbour is still to come.
            cut = len(tokens) - 1 if sizes[-1] > small else int(starts[-1])
            before = (n[cut - 1] if cut and tokens[cut - 1] == tokens[cut] else before if not cut and large == tokens[0] else -1) if sizes[-1] > small else -1
            large = tokens[-1] if sizes[-1] > small else None
            held = tuple(x[cut:] for x in now)
            size = np.repeat(sizes, np.diff(np.append(starts, len(tokens))))[:cut]
            tokens, rids, n = tokens[:cut], rids[:cut], n[:cut]
            yield from pairs_of(tokens, rids, n, size)
            big = (size > small) & met[:cut]
            if big.any():
                yield out(tokens[big], rids[big], None, n[big], None, False)
        if held is not None:
            tokens, rids, n = held
            if large is None:
                yield from pairs_of(tokens, rids, n, np.full(len(tokens), len(tokens)))
            elif with_neighbour(tokens, n, before, large)[0]:
                yield out(tokens, rids, None, n, None, False)

    # By rid too: two sets of one size must be the same (a, b) in all regions, however shuffle blocks arrive.
    return rows.repartition("token").sortWithinPartitions("token", "n", "rid").select("token", "rid", "n").mapInArrow(run, "token long, a long, b long, n_a int, n_b int")


def counted_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b) of small regions' pairs that share enough regions.

    Of two linked sets, let x be the one whose last pivot comes first. Shingles of both up to that pivot are pivots of both, and x has ceil(t|x|) - 1 others, so the two share at
    least ceil(t(|x| + |y|) / (1 + t)) - ceil(t|x|) + 1 regions; x is unknown, so the larger set stands for it. Large regions, whose pairs aren't counted, count as shared.
    """
    pairs = regions.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    in_large = regions.where("b IS NULL").groupBy("a").agg(F.count("*").alias("m"))
    known = pairs.join(in_large.withColumnRenamed("m", "m_a"), "a", "left").join(in_large.select(F.col("a").alias("b"), F.col("m").alias("m_b")), "b", "left")
    most = F.least(F.coalesce("m_a", F.lit(0)), F.coalesce("m_b", F.lit(0)))
    overlap = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return known.where(F.col("shared") + most >= overlap - F.ceil(F.lit(percent) * F.greatest("n_a", "n_b") / 100) + 1).select("a", "b", "n_a", "n_b")


def paired_edges(pairs: DataFrame, points: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that pass as points."""
    of_a = points.select(F.col("rid").alias("a"), F.col("counts").alias("c_a"))
    of_b = points.select(F.col("rid").alias("b"), F.col("counts").alias("c_b"))
    full = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")

    def run(iterator):
        for batch in slices(iterator, max(1, (2000 * 256) // buckets)):
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                c_a, c_b = (unpacked(batch.column(k), buckets) for k in (4, 5))
                ok = passes(n_a.astype(np.int64), n_b.astype(np.int64), c_a, c_b, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])
        give_back()

    return full.mapInArrow(lambda rows: forest_stream(run(rows)), "a long, b long")


def passes(n_a, n_b, c_a, c_b, percent: int, slack=0) -> np.ndarray:
    """Whether points of pivot counts may belong to linked sets."""
    apart = np.abs(c_a.astype(np.int16) - c_b.astype(np.int16)).sum(axis=-1)
    return (100 + percent) * (apart - slack) <= (100 - percent) * (n_a + n_b)


class LeaderRegion:
    """A large region as a stream of points by ascending size; keeps leaders only."""

    def __init__(self, percent: int, buckets: int):
        self.percent = percent
        self.n = self.reach = np.zeros(0, np.int64)
        self.rid, self.radius, self.c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, buckets), np.uint8)
        self.gone: list[tuple] = []

    def leaders(self) -> list[tuple]:
        """(rid, n, reach, radius, counts) of all leaders that there were."""
        return [*self.gone, *zip(self.rid.tolist(), self.n.tolist(), self.reach.tolist(), self.radius.tolist(), (c.tobytes() for c in self.c), strict=True)]

    def feed(self, n: int, rid: int, c: np.ndarray) -> np.ndarray:
        """Leaders that the new point is connected with."""
        # A leader may go once the new sizes are out of reach of all that it stands for.
        if len(self.n) and len(self.n) % 256 == 0:
            near = self.reach * 100 >= self.percent * n
            far = np.flatnonzero(~near)
            self.gone += [(int(self.rid[k]), int(self.n[k]), int(self.reach[k]), int(self.radius[k]), self.c[k].tobytes()) for k in far]
            self.n, self.reach, self.rid, self.radius, self.c = self.n[near], self.reach[near], self.rid[near], self.radius[near], self.c[near]
        apart = np.abs(self.c.astype(np.int16) - c.astype(np.int16)).sum(axis=1)
        bound = (100 - self.percent) * (self.reach + n) // (100 + self.percent)
        linked = apart <= bound + self.radius
        own = np.flatnonzero(apart <= (100 - self.percent) * n // (100 + self.percent))
        if len(own):
            k = own[0]
            self.radius[k] = max(self.radius[k], apart[k])
            self.reach[k] = max(self.reach[k], n)
        else:
            self.n, self.reach = np.append(self.n, n), np.append(self.reach, n)
            self.rid, self.radius, self.c = np.append(self.rid, rid), np.append(self.radius, 0), np.concatenate([self.c, c[None]])
        return self.rid[: len(linked)][linked]


def region_edges(tokens: np.ndarray, n: np.ndarray, rid: np.ndarray, c: np.ndarray, percent: int, small: int = 8, large: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of all passing pairs, over whole regions sorted by (token, n)."""
    a, b = [], []
    change = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    sizes = np.diff(np.append(change, len(tokens)))
    size_of = np.repeat(sizes, sizes)
    for step in range(1, small):
        first = np.flatnonzero((tokens[step:] == tokens[:-step]) & (size_of[step:] <= small)) if len(tokens) > step else np.zeros(0, np.int64)
        first = first[100 * n[first] >= percent * n[first + step]]
        ok = first[passes(n[first], n[first + step], c[first], c[first + step], percent)]
        a.append(rid[ok]), b.append(rid[ok + step])
    for at, size in zip(change[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        to = at + size
        if size > large:
            region = LeaderRegion(percent, c.shape[1])
            for i in range(at, to):
                found = region.feed(int(n[i]), int(rid[i]), c[i])
                a.append(found), b.append(np.full(len(found), rid[i]))
            continue
        # Labels instead of a list of pairs, of which a region of near copies has millions.
        label = np.arange(size)
        for i in range(at, to - 1):
            end = at + int(np.searchsorted(n[at:to], 100 * n[i] // percent, "right"))
            ok = np.flatnonzero(passes(n[i], n[i + 1 : end], c[i], c[i + 1 : end], percent)) + i + 1 - at
            joined = np.unique(label[np.append(ok, i - at)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        other = np.flatnonzero(label != np.arange(size))
        a.append(rid[at + other]), b.append(rid[at + label[other]])
    return np.concatenate(a), np.concatenate(b)


def candidate_edges(rows: DataFrame, points: DataFrame, buckets: int, percent: int, scratch: Scratch, share_bytes: int = 5 << 20) -> DataFrame:
    """(a, b): rows (token, rid) with their points (rid, n, counts), streamed region by region.

    A region whose points are more than share_bytes is dealt to several tasks. Each keeps leaders of its share, and then the leaders of all shares meet, in windows widened by the radii of both; near copies have few leaders, however many they are."""
    share_rows = max(2, share_bytes // buckets)
    rows = scratch.written(rows.join(points.select("rid"), "rid", "left_semi").select("token", "rid"), "region-rows-of-sizes")
    # A passage that several documents have in common makes a region of each of its shingles, with the same documents in all: one stands for all.
    members = rows.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rid")).alias("y")).where("m > 1")
    kept = scratch.written(members.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("m") / share_rows).cast("int").alias("shares")), "distinct-regions")
    large = kept.where("shares > 1")
    own_share = F.when(F.col("shares") > 1, F.pmod(F.xxhash64("rid"), F.col("shares")).cast("int")).otherwise(F.lit(-1))
    dealt = rows.join(kept, "token").select("token", "rid", own_share.alias("share"))
    placed = dealt.join(points, "rid").select("token", "share", "n", "rid", "counts")
    names = ["token", "a", "b", "n", "reach", "radius", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def links(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none, pa.nulls(len(a), pa.binary())], names)

    def heads(token, region):
        found = region.leaders()
        columns = list(zip(*[(token, rid, None, n, reach, radius, c) for rid, n, reach, radius, c in found], strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns[:-1], kinds, strict=False)), packed(columns[-1])], names)

    def run(iterator):
        held, key, region = None, None, None

        def whole():
            return links(*region_edges(held[0], held[2], held[3], held[4], percent))

        for batch in slices(iterator, point_rows(buckets)):
            counts = unpacked(batch.column(4), buckets)
            part = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), counts)
            shared = part[1] >= 0
            for k in np.split(np.arange(len(shared)), np.flatnonzero(np.diff(part[0]) | np.diff(part[1])) + 1):
                if not len(k):
                    continue
                token, share = int(part[0][k[0]]), int(part[1][k[0]])
                if share < 0:
                    continue
                if (token, share) != key:
                    if region is not None:
                        yield heads(key[0], region)
                    key, region = (token, share), LeaderRegion(percent, buckets)
                a, b = [], []
                for i in k.tolist():
                    found = region.feed(int(part[2][i]), int(part[3][i]), part[4][i])
                    a.append(found), b.append(np.full(len(found), part[3][i]))
                yield links(np.concatenate(a), np.concatenate(b))
            part = tuple(x[~shared] for x in part)
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            if not len(held[0]):
                held = None
                continue
            # The last region may go on in the next batch.
            last = int(np.searchsorted(held[0] == held[0][-1], True))
            if last:
                rest = tuple(x[last:] for x in held)
                held = tuple(x[:last] for x in held)
                yield whole()
                held = rest
        if held is not None:
            yield whole()
        if region is not None:
            yield heads(key[0], region)
        held = region = None
        give_back()

    found = placed.repartition("token", "share").sortWithinPartitions("token", "share", "n", "rid").mapInArrow(run, "token long, a long, b long, n long, reach long, radius long, counts binary")
    if large.limit(1).count() == 0:
        return found.select("a", "b")
    found = scratch.written(found, "region-links")
    return found.where("b IS NOT NULL").select("a", "b").unionByName(leader_links(found.where("b IS NULL"), buckets, percent))


def leader_links(leaders: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(a, b): leaders (token, a: rid, n, reach, radius, counts) of one region that may stand for linked sets, in a stream by ascending size."""

    def run(iterator):
        key, kept = None, None
        for batch in slices(iterator):
            a, b = [], []
            for token, rid, n, reach, radius, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if token != key:
                    key, kept = token, [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros((0, buckets), np.uint8)]
                c = np.frombuffer(pa.decompress(c, buckets, "zstd", asbytes=True), np.uint8)
                near = kept[1] * 100 >= percent * n
                if not near.all():
                    kept = [x[near] for x in kept]
                apart = np.abs(kept[3].astype(np.int16) - c.astype(np.int16)).sum(axis=1)
                ok = apart <= (100 - percent) * (kept[1] + reach) // (100 + percent) + kept[2] + radius
                a.append(kept[0][ok]), b.append(np.full(int(ok.sum()), rid))
                kept = [np.append(kept[0], rid), np.append(kept[1], reach), np.append(kept[2], radius), np.concatenate([kept[3], c[None]])]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])
        give_back()

    rows = leaders.select("token", F.col("a").alias("rid"), "n", "reach", "radius", "counts")
    return rows.repartition("token").sortWithinPartitions("token", "n", "rid").mapInArrow(run, "a long, b long")


def linked(n_a, n_b, shared, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def join_cell(rids: np.ndarray, sets: list[np.ndarray], percent: int, first: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the classes of exactly linked sets."""
    g = len(sets)
    n = np.array([len(s) for s in sets])
    if g == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return (rids[1:], rids[:1]) if linked(n[0], n[1], shared, percent) else (rids[:0], rids[:0])
    owner = np.repeat(np.arange(g, dtype=np.int32), n)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens)
    ordered = tokens[order]
    of = np.empty(len(tokens), np.int32)
    of[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.int32)
    del tokens, ordered
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(of))])
    bounds = np.concatenate([[0], np.cumsum(n)])
    found = UnionFind(g)

    def pivot(p: int) -> None:
        mine = of[bounds[p] : bounds[p + 1]]
        lengths = begin[mine + 1] - begin[mine]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1])) + np.repeat(begin[mine] - ends + lengths, lengths)
        shared = np.bincount(posting[at], minlength=g)
        for q in np.flatnonzero(linked(n[p], n, shared, percent)).tolist():
            found.union(p, q)

    done = set(range(min(first, g)))
    for p in done:
        pivot(p)
    roots = found.roots()
    largest = np.bincount(roots).argmax()
    for p in np.flatnonzero(roots != largest).tolist():
        if p not in done:
            pivot(p)
    roots = found.roots()
    other = np.flatnonzero(roots != np.arange(g))
    return rids[other], rids[roots[other]]


def distances(s: np.ndarray, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance from each pivot, whether linked with it); tokens: the pivots' shingles, ascending, and the pivot of each."""
    first, last = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
    runs = last - first
    ends = np.cumsum(runs)
    shared = np.bincount(owner[np.arange(int(ends[-1])) + np.repeat(first - ends + runs, runs)], minlength=len(sizes))
    return 1.0 - shared / (len(s) + sizes - shared), linked(len(s), sizes, shared, percent)


def regions_of(d: np.ndarray, percent: int) -> np.ndarray:
    """The Voronoi regions that a document belongs to: its own, and those within the window of twice the radius.

    Documents that are far from all pivots belong to the region beyond them, numbered len(d), where they meet each other; one that isn't far can only be linked with those of them that are
    within the radius of the border, which belong to its region too."""
    r = 1 - percent / 100
    if d.min() <= FAR:
        return np.flatnonzero(d <= d.min() + 2 * r + 1e-9)
    return np.append(np.flatnonzero(d <= FAR + r + 1e-9), len(d))


def pivoted(large: DataFrame, members: DataFrame, sets: DataFrame, percent: int, cell_tokens: int, most_pivots: int, turn: int) -> DataFrame:
    """For members of the `large` cells (cell, tokens, m): (a, b) links with pivots, b null otherwise; or their regions (a, cell, region, d, near). Tasks hold a cell's pivots and stream a share of its members."""
    known = large.withColumn("shares", F.ceil(F.col("tokens") * 2 / cell_tokens).cast("int"))
    place = F.xxhash64(F.lit(turn), "rid")
    own = members.join(known, "cell")
    # About four times as many as needed by hash, of them the first: no cell is gathered.
    drawn = own.where(F.pmod(place, F.col("m")) < 4 * F.least(F.col("shares"), F.lit(most_pivots))).groupBy("cell", "shares").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "rid"))).alias("drawn"))
    pivots = drawn.select("cell", "shares", F.explode(F.slice("drawn", 1, F.least(F.col("shares"), F.lit(most_pivots)))).alias("p")).select("cell", F.col("p.rid").alias("rid"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"))
    rest = own.select("cell", "rid", F.pmod(F.xxhash64("rid"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"))
    rows = pivots.unionByName(rest).join(sets.select("rid", "tokens"), "rid").select("cell", "share", "kind", "rid", "tokens")

    def run(iterator):
        key, pivots, held, found = None, {}, [], None
        names = ["a", "b", "cell", "region", "d", "near"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()]

        for batch in slices(iterator):
            out = []
            for cell, share, kind, rid, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if (cell, share) != key:
                    key, pivots, held, found = (cell, share), {}, [], None
                if kind == 0:
                    pivots[rid] = len(held)
                    held.append(s)
                    continue
                if not held:  # no pivot was drawn: the cell stays as it is
                    out.append((rid, None, cell, 0, 1.0, False))
                    continue
                if found is None:
                    sizes = np.array([len(x) for x in held])
                    all_tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(all_tokens)
                    ids, found = list(pivots), (all_tokens[order], owner[order], sizes)
                d, near = distances(s, *found, percent)
                out += [(rid, ids[k], cell, 0, 0.0, True) for k in np.flatnonzero(near).tolist() if ids[k] != rid]
                if rid not in pivots:
                    out += [(rid, None, cell, k, float(d[k]) if k < len(d) else 1.0, k < len(d) and bool(near[k])) for k in regions_of(d, percent).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        give_back()

    return rows.repartition("cell", "share").sortWithinPartitions("cell", "share", "kind", "rid").mapInArrow(run, "a long, b long, cell long, region int, d double, near boolean")


def divided(members: DataFrame, sets: DataFrame, percent: int, cell_tokens: int, scratch: Scratch, turns: int = 4, most_pivots: int = 16) -> tuple[DataFrame, list[DataFrame]]:
    """(members (rid, cell, n) of cells that are small or that pivots don't divide, links found with pivots)."""
    ready, links = [], []
    r = 1 - percent / 100
    for turn in range(turns):
        cells = scratch.written(members.groupBy("cell").agg(F.sum("n").alias("tokens"), F.count("*").alias("m")).where("m > 1"), "cells")
        large = cells.where((F.col("tokens") > cell_tokens) & (F.col("m") > 2))
        if large.limit(1).count() == 0:
            break
        found = scratch.written(pivoted(large, members, sets, percent, cell_tokens, most_pivots, turn), "voronoi-regions")
        links.append(found.where("b IS NOT NULL").select("a", "b"))
        placed = found.where("b IS NULL").select(F.col("a").alias("rid"), F.col("cell").alias("of"), F.xxhash64(F.lit(turn), "cell", "region").alias("cell"), "d", "near")
        # Of those linked with the pivot, the ones that a document beyond may still be linked with.
        beyond = placed.where("NOT near").groupBy("cell").agg(F.min("d").alias("least"))
        kept = placed.join(beyond.withColumnRenamed("cell", "c"), F.col("cell") == F.col("c")).where(~F.col("near") | (F.col("d") >= F.col("least") - r - 1e-9))
        kept = scratch.written(kept.join(members.select("rid", "n").distinct(), "rid").select("rid", "of", "cell", "n"), "voronoi-members")
        # A cell whose regions repeat it stays whole.
        cost = kept.groupBy("of", "cell").agg(F.sum("n").alias("t")).groupBy("of").agg(F.sum(F.col("t").cast("double") * F.col("t")).alias("cost"))
        worse = scratch.written(cost.join(large.withColumnRenamed("cell", "of"), "of").where(F.col("cost") > 0.7 * F.col("tokens").cast("double") * F.col("tokens")).select("of"), "undivided-cells")
        whole = large.join(worse.withColumnRenamed("of", "cell"), "cell", "left_semi").select("cell")
        ready.append(members.join(large.select("cell"), "cell", "left_anti").unionByName(members.join(whole, "cell", "left_semi")).select("rid", "cell", "n"))
        members = scratch.written(kept.join(worse, "of", "left_anti").select("rid", "cell", "n"), "region-members")
    return reduce(DataFrame.unionByName, ready, members.select("rid", "cell", "n")), links


def exact_edges(members: DataFrame, sets: DataFrame, percent: int, cell_tokens: int, scratch: Scratch, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(a, b): edges that hold the exact classes in each cell; members is (rid, cell)."""
    members = scratch.written(members.join(sets.select("rid", "n"), "rid").select("rid", "cell", "n"), "sized-members")
    members, links = divided(members, sets, percent, cell_tokens, scratch)
    blocks = members.groupBy("cell").agg(F.ceil(F.sum("n") / (cell_tokens / 2)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    block = F.when(F.col("blocks") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = scratch.written(
        members.join(blocks, "cell").withColumn("block", block).withColumn("other", F.explode(others)).select("rid", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")),
        "cell-members",
    )
    side = F.broadcast(placed) if placed.count() <= broadcast_rows else placed  # rows of 24 bytes
    rows = sets.select("rid", "tokens").join(side, "rid").select("cell", "i", "j", "rid", "tokens")

    def run(iterator):
        key, rids, held = None, [], []

        def out():
            a, b = join_cell(np.array(rids), held, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(iterator):
            for *now, rid, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if len(held) > 1:
                        yield out()
                    key, rids, held = now, [], []
                rids.append(rid)
                held.append(np.frombuffer(tokens, np.uint64))
        if len(held) > 1:
            yield out()
        held = []
        give_back()

    joined = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rid").mapInArrow(run, "a long, b long")
    return reduce(DataFrame.unionByName, links, joined)


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", cell_tokens: int = 1_500_000) -> DataFrame:
    """id, n_shingles, component_id per row of docs; component_id is the smallest id of the row's class."""
    found = _classes(docs, n, percent, id_col, text_col, cell_tokens)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell_tokens: int = 1_500_000) -> DataFrame:
    """docs with one document of each class: that of the smallest id, null ids last, and of rows of one id that with the smallest hash of its text.

    Rows that repeat both an id and a text are reduced to one, that with the smallest hash of all its columns."""
    found = _classes(docs, n, percent, id_col, text_col, cell_tokens)
    doc, mark = free_name("doc", docs), free_name("mark", docs)
    in_class = found.where("class IS NOT NULL")
    first = in_class.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first"))
    gone = in_class.join(first, "class").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))).select(F.col("id").alias(doc), F.col("mark").alias(mark)).distinct()
    gone = beside(written(gone, "copies-to-go"), F.lit(32))
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (own == F.col(mark))
    left = docs.join(gone, same, "left_anti")
    again = found.groupBy(F.col("id").alias(doc), F.col("mark").alias(mark)).count().where("count > 1").drop("count")
    if again.limit(1).count() == 0:
        return left
    place = F.xxhash64(*[F.col(c) if t in ("string", "long", "bigint", "int") else F.to_json(F.struct(c)) for c, t in docs.dtypes])
    one = left.join(again, same).groupBy(doc, mark).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), place).alias("row"))
    return left.join(again, same, "left_anti").unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, cell_tokens: int) -> DataFrame:
    """id, mark (of the text), n, component_id, class (null for a document alone) of each row, as a written table; all that was written on the way is deleted."""
    with arrow_rows(docs.sparkSession, 2000), Scratch(docs.sparkSession) as scratch:
        return written(_found_classes(docs, n, percent, id_col, text_col, cell_tokens, scratch), "classes-of-rows")


def equal_sets(sets: DataFrame, scratch: Scratch, broadcast_sets: int = 500_000) -> DataFrame:
    """(rid, rep) of the rows whose sets repeat; one row stands for all. Digests that repeat (24 bytes a row) are broadcast while there are few, so that a set with very many copies goes to no task of its own."""
    equal = scratch.written(sets.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("digest", "rep"), "equal-digests")
    side = F.broadcast(equal) if equal.count() <= broadcast_sets else equal
    return scratch.written(sets.where("n > 0").select("rid", "digest").join(side, "digest").select("rid", "rep"), "equal-sets")


def _found_classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, cell_tokens: int, scratch: Scratch) -> DataFrame:
    sets = set_table(docs, n, id_col, text_col, scratch)
    copies = equal_sets(sets, scratch)
    regions = scratch.written(shared_regions(region_rows(sets, *frequent_tokens(sets), percent), percent), "regions")
    pairs = scratch.written(counted_pairs(regions, percent), "region-pairs")
    rows = regions.where("b IS NULL").select("token", F.col("a").alias("rid"))
    standing = scratch.written(rows.join(copies.where("rid != rep"), "rid", "left").select("token", F.coalesce("rep", "rid").alias("rid")).distinct(), "region-rows")
    scratch.drop(regions)
    wanted = rid_map(pairs.select(F.explode(F.array("a", "b")).alias("rid"))), rid_map(standing.select("rid"))
    largest = sets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found, low = [], 0
    for high, buckets in SIZES:
        if low < max(largest, 1):
            points = scratch.written(points_of(sets, low, high, buckets, percent, *wanted), "points")
            own = pairs.where((F.greatest("n_a", "n_b") > low) & (F.greatest("n_a", "n_b") <= high))
            tested = paired_edges(own, points.where("paired"), buckets, percent).unionByName(candidate_edges(standing, points.where("met"), buckets, percent, scratch))
            found.append(scratch.written(tested, "candidate-edges"))
            scratch.drop(points)
        low = high
    return classes_of_candidates(reduce(DataFrame.unionByName, found), sets, copies, percent, cell_tokens, scratch)


def classes_of_candidates(edges: DataFrame, sets: DataFrame, copies: DataFrame, percent: int, cell_tokens: int, scratch: Scratch) -> DataFrame:
    """id, mark, n, component_id, class (null for a document alone) of each row of sets; what edges (a, b) connect holds all links."""
    # Copies met in different tasks stand for one set from here on.
    met = edges.select(F.col("a").alias("rid")).union(edges.select("b")).distinct()
    cells = components(edges.unionByName(copies.where("rid != rep").join(met, "rid", "left_semi").select(F.col("rid").alias("a"), F.col("rep").alias("b"))), scratch)
    cells = cells.join(copies.where("rid != rep").select(F.col("rid").alias("node")), "node", "left_anti")
    exact = exact_edges(cells.select(F.col("node").alias("rid"), F.col("component").alias("cell")), sets, percent, cell_tokens, scratch)
    links = scratch.written(exact.unionByName(copies.where("rid != rep").select(F.col("rid").alias("a"), F.col("rep").alias("b"))), "links")
    classes = scratch.written(components(links, scratch), "classes")
    named = classes.join(sets.select("rid", "id"), classes["node"] == F.col("rid")).groupBy("component").agg(F.min("id").alias("component_id"))
    of_row = classes.join(named, "component").select(F.col("node").alias("rid"), "component_id", F.col("component").alias("class"))
    component = F.when(F.col("class").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return sets.select("rid", "id", "mark", "n").join(of_row, "rid", "left").select("id", "mark", "n", component.alias("component_id"), "class")
