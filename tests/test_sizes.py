"""Work that must grow with the input and no faster: long lines, long arrays, many small shards, many queries."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np

from pyspark.sql import functions as F

from lexilink.functions.encoder import hashing_encoder
from lexilink.operators import abbreviations as A
from lexilink.operators import corpus as C
from lexilink.operators import evaluation as E
from lexilink.operators import identifiers as I
from lexilink.operators import retrieval as R
from lexilink.operators import sharding as H
from lexilink.operators.indexstore import VectorIndex
from lexilink.sources.shards import EmbeddedShards, GrowingStore


def test_parentheses_of_long_lines():
    line = "word " * 20_000
    began = time.perf_counter()
    assert A.extract_pairs(f"{line}multiple sclerosis (MS) {line}(") == [("MS", "multiple sclerosis")]
    assert A.extract_pairs("(a) " * 20_000 + "multiple sclerosis \n (MS)") == [("MS", "multiple sclerosis")]
    assert time.perf_counter() - began < 5
    assert list(A.parentheses("ab (cd) e\nfg \t\n(hi)((jk) l(mn)")) == [("ab", "cd"), ("fg", "hi"), ("", "jk"), (" l", "mn")]


def test_mentions_of_long_arrays(spark):
    """Tokens that are an expression are made once a row, not once for each token."""
    words = F.split(F.repeat(F.lit("a bb ccc "), 4000), " ", -1)
    tokens = F.transform(words, lambda w: F.when(F.length(w) == 1, F.lit(-1)).when(F.length(w) == 3, F.lit(-2)).otherwise(F.length(w)))
    began = time.perf_counter()
    # The last word is empty, and of no mention.
    found = spark.range(2).select(C.extract_mentions(tokens, -1, -2).alias("m")).collect()
    assert all(r.m == [[2]] * 4000 for r in found) and time.perf_counter() - began < 20


def test_reverse_makes_lists_once_for_each_set_of_ints(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("b", 1), ("c", 1), ("d", 9), ("c", 9), ("e", None)], "key string, int_id int")
    mapping = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "w"), (1, "x"), (3, "z"), (1, None), (None, "q")], "int_id int, id string")
    assert {r.key: r.ids for r in I.reverse(rows, "key", mapping).collect()} == {"a": ["w", "x", "y"], "b": ["w", "x", "y"], "c": ["x", "y"]}
    many = spark.range(20_000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("int_id"))
    wide = spark.range(40_000).select((F.col("id") % 2).cast("int").alias("int_id"), F.col("id").cast("string").alias("id"))
    began = time.perf_counter()
    r = I.reverse(many, "key", wide).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    assert (r.n, r.ids) == (20_000, 400_000_000) and time.perf_counter() - began < 60


_LONG_LISTS = """
from pyspark.sql import Observation, functions as F
from lexilink.operators import identifiers as I
from lexilink.session import build_session

spark = build_session("local[2]", 4, spark__driver__memory="600m")
rows = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("int_id"))
mapping = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("int_id"), F.format_string("identifier-%08d", "id").alias("id"))
seen = Observation()
found = I.reverse(rows, "key", mapping, lambda ids: F.array_join(ids, ","))
found.observe(seen, F.count("*").alias("n"), F.sum(F.length("ids")).alias("chars")).write.format("noop").mode("overwrite").save()
print(seen.get)
"""


def test_reverse_does_not_hold_all_rows_of_a_long_list(tmp_path):
    """2000 rows of 1 MB, of two lists, in a JVM of 600 MB."""
    repo = str(Path(I.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", _LONG_LISTS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    assert str({"n": 2000, "chars": 2000 * (50_000 * 20 - 1)}) in done.stdout, done.stderr[-2000:]


def test_reverse_deals_out_rows_by_the_bytes_of_their_lists(spark, monkeypatch):
    monkeypatch.setattr(I, "LIST_BYTES", 10_000, raising=False)
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 2900, 1).otherwise(F.col("id") % 3).cast("int").alias("int_id"))
    mapping = spark.range(300).select((F.col("id") % 3).cast("int").alias("int_id"), F.format_string("%09d", "id").alias("id")).unionByName(spark.range(5).select(F.lit(1).alias("int_id"), F.format_string("%09d", F.lit(1)).alias("id")))
    found = I.reverse(rows, "key", mapping)
    sizes = [len(x) for x in found.rdd.glom().collect()]
    # 3000 lists of 1000 bytes: ten go to a task, but for what hashes put together.
    assert len(sizes) == 300 and max(sizes) < 100
    want = {i: [f"{x:09d}" for x in range(i, 300, 3)] for i in range(3)}
    assert {r.key: r.ids for r in found.collect()} == {k: want[1 if k < 2900 else k % 3] for k in range(3000)}


def test_embedding_many_small_shards_takes_few_jobs_and_folders(spark, tmp_path):
    rows = spark.range(0, 400).select(F.col("id").alias("uid"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    store = EmbeddedShards(spark, f"{tmp_path}/e")
    assert store.write(rows, "uid", "text", hashing_encoder(8), 10, 2, most_jobs=1) == [0, 1]
    assert store.write(rows, "uid", "text", hashing_encoder(8), 10, 2) == list(range(2, 40))
    # Two shards, then 2, 4, 8, 16 and the 8 that are left.
    known = store.manifest().read()
    assert len(known["folders"]) == 6 and known["whole"] == list(range(40))
    got = sorted((r.shard, r.position, r.uid) for r in store.store().rows().collect())
    assert got == [(k // 10, k % 10, k) for k in range(400)]
    assert [r.uid for r in store.store().row(137).collect()] == [137] and store.store().shard_size() == 10
    # A shard that is missing between whole ones.
    store._publish(known | {"whole": [k for k in range(40) if k not in (5, 6, 9)], "folders": []})
    assert store.write(rows, "uid", "text", hashing_encoder(8), 10, 2) == [5, 6, 9]
    assert sorted(r.shard for r in store.store().rows().select("shard").distinct().collect()) == [5, 6, 9]


def test_scores_held_at_once_are_bounded(monkeypatch):
    sizes, plain = [], R.score_block
    monkeypatch.setattr(R, "MOST_SCORES", 500)
    monkeypatch.setattr(R, "score_block", lambda *a: sizes.append(plain(*a).size) or plain(*a))
    rng = np.random.default_rng(3)
    q, x, uids = rng.normal(size=(40, 4)), np.round(rng.normal(size=(333, 4)), 1), rng.permutation(333)
    top = R.RunningTop(7)
    R.add_best(top, 100 + np.arange(40), q, uids, x, "ip")
    scores = plain(q, x, "ip")
    r, c = R.best_of(scores, uids, 7)
    assert max(sizes) <= 500 and list(zip(top.rows, top.uids, top.scores, strict=True)) == list(zip(100 + r, uids[c], scores[r, c], strict=True))


def test_probes_reach_a_recall_where_vectors_have_no_clusters(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(4000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "uid long, embedding array<float>").cache()
    queries = rows.where("uid % 50 = 0").withColumnRenamed("uid", "mention")
    index = VectorIndex.build(rows, f"{tmp_path}/i", "ivf", factor=0.5, recall=0.95)
    found = index.search(queries, 10).select("mention", "uid").join(R.knn(queries, rows, 10), ["mention", "uid"]).count()
    assert found >= 0.9 * 10 * 80 and index.trained.probes <= index.trained.n_cells
    assert VectorIndex.open(spark, f"{tmp_path}/i").trained.probes == index.trained.probes


def test_refined_candidates_reach_a_recall_where_codes_are_coarse(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(3000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "uid long, embedding array<float>").cache()
    queries = rows.where("uid % 50 = 0").withColumnRenamed("uid", "mention")
    true = R.knn(queries, rows, 10)
    for kind in ("pq", "ivfpq"):
        index = VectorIndex.build(rows, f"{tmp_path}/{kind}", kind, factor=0.5, codes=2, bits=4, recall=0.95)
        assert index.search(queries, 10).select("mention", "uid").join(true, ["mention", "uid"]).count() >= 0.9 * 10 * 60
        assert VectorIndex.open(spark, f"{tmp_path}/{kind}").trained.refine == index.trained.refine > 8


def test_ranges_of_many_borders(spark):
    rows = spark.range(-3, 900).select(F.when(F.col("id") != 7, F.col("id") / 3).alias("v"))
    for borders in ([0.0], [0.0, 1.0], [k / 2 for k in range(501)]):
        got = {r.v: r.at for r in rows.select("v", H.range_of(F.col("v"), borders).alias("at")).collect()}
        assert got == {v: 0 if v is None else sum(b <= v for b in borders) for v in got}
    # Every border was compared with every row's value before, and the value made anew for each.
    value = F.regexp_replace(F.regexp_replace(F.lower(F.concat(F.lit("Shard "), F.col("id").cast("string"), F.repeat(F.lit(" x"), 20))), "[^a-z0-9]", " "), " +", " ")
    began = time.perf_counter()
    spark.range(400_000).select(H.range_of(value, [f"shard {k:04d}" for k in range(1000)]).alias("at")).agg(F.sum("at")).collect()
    assert time.perf_counter() - began < 30


def test_appending_many_small_shards_takes_few_files(spark, tmp_path):
    store = GrowingStore(spark, f"{tmp_path}/g")
    for first, last in ((0, 3000), (3000, 3005), (3005, 6000)):
        assert store.append(spark.range(first, last).select(F.col("id").alias("uid")), ["uid"], 7) == last
    assert len(list(tmp_path.glob("g/batch=*/**/*.parquet"))) < 40
    assert sorted((r.shard, r.position, r.uid) for r in store.rows().collect()) == [(k // 7, k % 7, k) for k in range(6000)]
    assert [r.uid for r in store.row(3001).collect()] == [3001]


def test_common_mentions_are_shuffled_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 1), (None, 1), (None, 2), ("c", 2), ("c", None), ("c", 1)], "hexdigest string, model int")
    found = E.common_mentions(rows, 2)
    assert {r.hexdigest for r in found.collect()} == {"a", None, "c"}
    assert found._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange hashpartitioning") == 1
