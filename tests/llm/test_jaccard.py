import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilink.llm import jaccard
from lexilink.llm.jaccard import jaccard_classes, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=85, n=4):
    """(n_shingles, component_id) by id, through an inverted index over all shared shingles."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for q, shared in Counter(q for t in s for q in index[t]).items():
            if 100 * shared >= percent * (len(s) + len(sets[q]) - shared):
                a, b = sorted((find(i), find(q)))
                parent[b] = a
        for t in s:
            index[t].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def near_copies(seed=0, groups=12, size=14):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(groups):
        base = [f"w{g}_{i}" for i in rng.integers(0, 400, int(rng.integers(5, 220)))]
        for _ in range(size):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**9)}"
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.85, 1.0)))]
            if rng.random() < 0.3:
                words += passage
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows


def test_near_copies_equal_brute_force(spark):
    rows = near_copies() + [(2000, None), (2001, ""), (2002, "A b"), (2003, "a  B\n"), (2004, "a b c"), (2005, "a b c d"), (2006, "x " * 5000), (2007, "x " * 4000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_blocks_and_leaders_equal_brute_force(spark, monkeypatch):
    rows = near_copies(3, 3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, shared = jaccard.region_edges, jaccard.shared_regions
    monkeypatch.setattr(jaccard, "shared_regions", lambda *a: shared(*a, small=2))
    monkeypatch.setattr(jaccard, "region_edges", lambda *a: plain(*a, small=2, large=3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, cell_tokens=4000).collect()}
    assert got == brute(rows)
    # Regions dealt to several tasks, whose leaders meet afterwards.
    dealt = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda *a: dealt(*a, share_bytes=7 * a[2]))
    # Sets of all ranges of sizes.
    monkeypatch.setattr(jaccard, "SIZES", ((20, 16), (60, 64), (1 << 62, 512)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_equal_sizes_in_any_order_equal_brute_force(spark, monkeypatch):
    rows = []
    for g in range(30):
        words = [f"w{g}_{i}" for i in range(200)]
        rows.append((2 * g, " ".join(words)))
        for k in range(3):
            words[50 + 40 * k] = f"e{g}_{k}"
        rows.append((2 * g + 1, " ".join(words)))
    plain = jaccard.region_rows

    def swapped(*a):
        """As other executors' blocks may arrive: rows of every other region the other way round."""
        found = sorted(map(tuple, plain(*a).collect()), key=lambda r: r[1] if r[0] % 2 else -r[1])
        return spark.createDataFrame(spark.sparkContext.parallelize(found, 1), "token long, rid long, n int")

    monkeypatch.setattr(jaccard, "region_rows", swapped)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(5))
def test_leader_regions_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(4)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(0, 4)].copy()
        s[rng.integers(0, 200, rng.integers(0, 20))] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(s[: rng.integers(160, 201)]))
    sets.sort(key=len)
    n, c, rid = np.array([len(s) for s in sets]), jaccard.counts_by_class(sets), np.arange(len(sets))
    a, b = jaccard.region_edges(np.zeros(len(sets), np.int64), n, rid, c, 85, small=1, large=5)
    group = jaccard.UnionFind(len(sets))
    for x, y in zip(a, b, strict=True):
        group.union(int(x), int(y))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j])), 85):
                assert group.find(i) == group.find(j)


def test_repeated_ids_null_ids_and_empty_table(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, "other"), (None, text), (None, "z"), (3, text)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_classes(df).collect()), key=repr)
    assert got == sorted([(1, 47, 1), (1, 1, 1), (None, 47, 1), (None, 1, None), (3, 47, 1)], key=repr)
    assert jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_voronoi_regions_lose_no_link(spark, monkeypatch, seed):
    """One cell of several groups of copies, some near and some not, divided again and again."""
    from lexilink.llm.common import Scratch

    rng = np.random.default_rng(seed)
    sets, shared = [], rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    for _ in range(6):
        s = np.concatenate([shared, rng.integers(0, 1 << 63, 170, dtype=np.uint64)])
        for _ in range(25):
            changed = s.copy()
            changed[rng.integers(30, 200, rng.integers(1, 40))] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            sets.append(np.unique(changed))
    n = [len(s) for s in sets]
    table = spark.createDataFrame([(i, m, bytearray(s.tobytes())) for i, (m, s) in enumerate(zip(n, sets, strict=True))], "rid long, n long, tokens binary")
    members = spark.createDataFrame([(i, 1) for i in range(len(sets))], "rid long, cell long")
    turns, plain = [], jaccard.pivoted
    monkeypatch.setattr(jaccard, "pivoted", lambda *a: turns.append(a[-1]) or plain(*a))
    with Scratch(spark) as scratch:
        edges = jaccard.exact_edges(members, table, 85, 1500, scratch).collect()
    assert len(turns) >= 2
    group, exact = jaccard.UnionFind(len(sets)), jaccard.UnionFind(len(sets))
    for e in edges:
        group.union(e.a, e.b)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j])), 85):
                exact.union(i, j)
    assert group.roots().tolist() == exact.roots().tolist()


def test_one_stays_of_each_class(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*base[:50], f"x{k}", *base[51:]])
    rows = [(1, near(1)), (1, near(2)), (5, near(3)), (None, near(4)), (None, "q " * 40 + "a"), (None, "q " * 40 + "a"), (7, "alone"), (7, "alone"), (8, None), (8, None), (9, "")]
    rows += [(None, " ".join(f"z{i}" for i in range(60))), (None, " ".join([*(f"z{i}" for i in range(60)), "end"]))]
    df = spark.createDataFrame([(*r, i, {"k": str(i)}, "v", 2) for i, r in enumerate(rows)], "doc_id long, text string, __id int, _mark map<string,string>, _doc string, class int").repartition(4)
    got = keep_one(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    left = sorted(((r.doc_id, (r.text or "-")[:1]) for r in got.collect()), key=repr)
    assert left == sorted([(1, "w"), (None, "q"), (7, "a"), (8, "-"), (9, "-"), (None, "z")], key=repr)
    assert sorted(map(str, keep_one(df.repartition(3)).collect())) == sorted(map(str, got.collect()))


def test_large_regions_keep_rows_with_a_neighbour_in_size(spark):
    """A row of a large region stays just if another one's size allows a link, wherever Arrow cuts the region."""
    from lexilink.llm.common import arrow_rows

    sizes = {1: [10, 20, 22, 40, 80, 81, 82, 200, 400, 401], 2: [5, 5], 3: [100 * 2**k for k in range(12)], 4: [7 * 2**k for k in range(11)] + [7 * 2**10 + 1]}
    rows = [(t, 100 * t + k, n) for t, ns in sizes.items() for k, n in enumerate(ns)]
    table = spark.createDataFrame(rows, "token long, rid long, n int").coalesce(1)
    kept = {(t, rid) for t, rid, n in rows if len(sizes[t]) > 8 and any(r != rid and u == t and 100 * min(n, m) >= 85 * max(n, m) for u, r, m in rows)}
    for most in (1, 2, 3, 7, 1000):
        with arrow_rows(spark, most):
            found = jaccard.shared_regions(table, 85).collect()
        assert sorted((r.token, r.a) for r in found if r.b is None) == sorted(kept)
        assert [(r.token, r.a, r.b) for r in found if r.b is not None] == [(2, 200, 201)]


def test_points_are_packed():
    sets = [np.sort(np.random.default_rng(k).integers(0, 2**63, 3000).astype(np.uint64)) for k in range(4)]
    counts = jaccard.counts_by_class(sets, 4096)
    column = jaccard.packed(counts)
    assert (jaccard.unpacked(column, 4096) == counts).all() and max(len(c.as_py()) for c in column) < 1600
    assert jaccard.unpacked(column[:0], 4096).shape == (0, 4096)


def test_points_are_made_only_of_sets_that_are_compared(spark, monkeypatch):
    words = [" ".join(f"w{k}_{i}" for i in range(60)) for k in range(300)]
    rows = [*enumerate(words), *((300 + k, f"{words[k]} more") for k in range(10))]
    counts, edges = [], jaccard.paired_edges
    monkeypatch.setattr(jaccard, "paired_edges", lambda own, points, *a: counts.append(points.count()) or edges(own, points, *a))
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - 300 if k >= 300 else k for k in range(310)}
    assert len(counts) == 1 and 20 <= counts[0] < 30


def test_map_of_rids_holds_all_of_them(spark):
    rids = spark.range(0, 5000, 7).select((F.col("id") + (F.col("id") % 3) * (1 << 33)).alias("rid"))
    bits = jaccard.rid_map(rids.union(rids), 1 << 16)
    at = np.array([r.p for r in rids.select(jaccard._bit_place(1 << 16).alias("p")).distinct().collect()])
    assert len(bits) == 1 << 13 and sorted(np.flatnonzero(np.unpackbits(bits, bitorder="little"))) == sorted(at)
    assert not jaccard.rid_map(rids.limit(0), 1 << 16).any()
