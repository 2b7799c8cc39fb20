"""Queries that must read all their rows, against brute force on small tables."""

import re
from collections import defaultdict

from lexilink.operators.textsim import indel_ratio
from lexilink.plans import catalog

PARTS = [
    (k, name, f"Brand#{brand}", size)
    for k, (name, brand, size) in enumerate([("red tin", 1, 2), ("red tin", 1, 2), ("red, tins", 1, 3), ("blue", 2, 4), ("blue", 1, 4), ("blue", 2, 5), ("bluer", 2, 5), ("green pan", 3, 6), ("red tin", 3, 2), ("greens", 1, 7), ("blue", 2, 4)], 1)
]


def test_ambiguous_mentions_of_all_names(spark, tmp_path):
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    kb = [(k, brand, f"{name} {size}", k % 5) for k, name, brand, size in PARTS]
    foreign, brands = defaultdict(set), defaultdict(set)
    for _, brand, name, f in kb:
        foreign[name].add(f)
        brands[name, f].add(brand)
    plain = lambda t: re.sub(" +", " ", re.sub(r"[^\w]", " ", t.lower())).strip()
    best = [max((indel_ratio(plain(name), plain(c)) for _, b, c, f in kb if b == brand and (len(foreign[c]) > 1 or len(brands[c, f]) > 1)), default=0) for _, brand, name, _ in kb]
    got = catalog.queries()["ambiguous_mentions"](spark, str(tmp_path)).first().asDict()
    assert got == {f"at_{t}": sum(x >= t for x in best) for t in (80, 85, 95, 100)}
    assert got["at_100"] > 3


def test_sharded_search_reads_all_query_blocks(spark, monkeypatch):
    from functools import partial

    from lexilink.operators import retrieval as R

    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in catalog.queries()["knn_sharded_merge"](spark, d).collect()}
    monkeypatch.setattr(R, "query_blocks", partial(R.query_blocks, most=40))
    got = catalog.queries()["knn_sharded_merge"](spark, d).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_lengths_that_may_reach_a_ratio_are_in_near_classes(spark):
    from pyspark.sql import functions as F

    from lexilink.operators.textsim import length_classes

    for least in (100, 95, 80, 50, 0):
        rows = spark.range(0, 200).select(F.col("id").cast("int").alias("n"))
        of, apart = length_classes(F.col("n"), least)
        found = {r.n: r.c for r in rows.select("n", of.alias("c")).collect()}
        near = [(a, b) for a in range(200) for b in range(200) if a + b and 200 * min(a, b) >= least * (a + b)]
        assert all(found[b] - found[a] in apart for a, b in near if least > 0 or a * b)
