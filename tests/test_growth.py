"""Parallel line files, growing stores, resumed embeddings, index versions and addressed candidates."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexilink.functions.encoder import hashing_encoder
from lexilink.operators import candidates as C
from lexilink.operators import retrieval as R
from lexilink.sources import lines as L
from lexilink.sources import writers as X
from lexilink.sources.manifests import Manifest
from lexilink.sources.pubtator import read_pubtator
from lexilink.sources.shards import EmbeddedShards, GrowingStore, ShardStore, write_shards
from lexilink.streaming.index_refresh import IndexVersions, RefreshingSearch

BREAKS = ["plain", "a\nb", "a\r\n\tb", "\n\n", None, "", "tab\tx", "ü é"]


def test_parallel_files_survive_line_breaks(spark, tmp_path):
    rows = [(k, BREAKS[k % 8], f"t{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "k long, source string, target string").repartition(7)
    L.write_parallel(df, ["k"], ["source", "target"], f"{tmp_path}/p")
    got = [(r.place, r.source, r.target) for r in L.read_parallel(spark, f"{tmp_path}/p", ["source", "target"]).orderBy("place").collect()]
    assert got == [(k, "".join(" " if c in "\r\n\t" else c for c in s or ""), t) for k, s, t in rows]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    for name, n in (("f10.txt", 300), ("f2.txt", 5000), ("f1.txt", 0), ("g.txt", 1)):
        (tmp_path / name).write_text("".join(f"{name} line {i} {'x' * (i % 50)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = L.numbered_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{name} line {i} {'x' * (i % 50)}" for name, n in (("f2.txt", 5000), ("f10.txt", 300), ("g.txt", 1)) for i in range(n)]
    assert {r.place: r.value for r in got} == dict(enumerate(want)) and len(got) == len(want)


def test_files_of_other_lengths_are_an_error(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4)):
        (tmp_path / f"file={name}").mkdir()
        (tmp_path / f"file={name}" / "x.txt").write_text("line\n" * n)
    with pytest.raises(PySparkException):
        L.read_parallel(spark, str(tmp_path), ["a", "b"]).collect()


def test_offsets_index_into_the_written_files(spark, tmp_path):
    texts = [(1, 0, "Two\n\nbreaks here"), (1, 1, "tab\there and\r\nthere"), (2, 0, None), (2, 1, "x")]
    passages = spark.createDataFrame(texts, "eid long, passage_id long, text string")
    marks = [(1, 5, 11, "breaks", "T", ["1"]), (1, 17, 25, "tab\there", "T", ["2"]), (1, 31, 36, "there", "T", ["3"])]
    X.write_contents(X.pubtator_documents(passages, spark.createDataFrame(marks, "eid long, start long, end long, text string, type string, ids array<string>")), f"{tmp_path}/p")
    lines, found = read_pubtator(spark, f"{tmp_path}/p")
    whole = {r.pmid: r.text for r in lines.groupBy("pmid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("kind") == "a").alias("k"), "text"))), lambda s: s["text"]), " ").alias("text")).collect()}
    got = found.collect()
    assert len(got) == 3 and all(whole[r.pmid][r.start : r.end] == r.text for r in got)


def test_appended_annotations_come_first_and_relations_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1|t|A|b\n1|a|\n1\t0\t1\tA\tGene\t7\n1\tAssociation\t7\t8\tNovel\n\n2|t|B\n2|a|c\n\n")
    new = spark.createDataFrame([(1, 3, 4, "b", "Species", ["9"]), (1, 0, 1, "A", "Species", ["8"]), (2, 0, 1, "B", "Gene", [])], "eid long, start long, end long, text string, type string, ids array<string>")
    X.append_pubtator(spark, f"{tmp_path}/in", new, f"{tmp_path}/out")
    blocks = {r.content.split("|")[0].strip(): r.content.strip("\n") for r in X.read_contents(spark, f"{tmp_path}/out", "\n\n").collect()}
    assert blocks["1"] == "1|t|A|b\n1|a|\n1\t0\t1\tA\tSpecies\t8\n1\t3\t4\tb\tSpecies\t9\n1\t0\t1\tA\tGene\t7\n1\tAssociation\t7\t8\tNovel"
    assert blocks["2"] == "2|t|B\n2|a|c\n2\t0\t1\tB\tGene\t"


def test_manifest_versions_are_published_once(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    assert m.read() is None and m.versions() == []
    assert m.publish(1, {"a": "ü"}) and m.publish(2, {"a": 2}) and not m.publish(2, {"a": 3})
    assert m.read() == {"a": 2} and m.read(1) == {"a": "ü"} and m.read(7) is None and m.versions() == [1, 2]


def test_append_fills_the_last_shard_and_failed_batches_are_not_read(spark, tmp_path, monkeypatch):
    store = GrowingStore(spark, f"{tmp_path}/s")
    rows = lambda a, b: spark.range(a, b).withColumn("v", F.col("id") * 2)
    assert store.append(rows(0, 25), ["id"], 10) == 25 and store.append(rows(25, 32), ["id"]) == 32
    monkeypatch.setattr(Manifest, "publish", lambda *_: False)
    with pytest.raises(RuntimeError):
        store.append(rows(32, 99), ["id"])
    monkeypatch.undo()
    assert store.append(rows(32, 32), ["id"]) == 32 and store.append(rows(32, 41), ["id"]) == 41
    got = sorted((r.shard, r.position, r.id, r.v) for r in store.rows().collect())
    assert got == [(k // 10, k % 10, k, 2 * k) for k in range(41)] and store.shard_size() == 10
    assert [r.v for r in store.row(37).collect()] == [74]
    with pytest.raises(ValueError):
        GrowingStore(spark, f"{tmp_path}/none").rows()


def test_gather_reads_only_what_is_asked_for(spark, tmp_path):
    write_shards(spark.range(0, 95).withColumn("name", F.concat(F.lit("n"), F.col("id"))), f"{tmp_path}/s", ["id"], 10)
    store = ShardStore(spark, f"{tmp_path}/s")
    wanted = spark.createDataFrame([("a", 94), ("b", 3), ("c", 3), ("d", 95), ("e", None)], "k string, row long")
    for options in ({}, {"most_shards": 1}, {"most_rows": 1}):
        found = store.gather(wanted, columns=["name"], **options)
        assert found.columns == ["k", "row", "name"]
        assert {r.k: r.name for r in found.collect()} == {"a": "n94", "b": "n3", "c": "n3", "d": None, "e": None}
    plan = store.gather(wanted.where("k = 'a'"), columns=["name"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "(shard#" in plan and "= 9)" in plan


def test_embedding_goes_on_where_it_was_killed(spark, tmp_path):
    rows = spark.range(0, 50).select(F.col("id").alias("uid"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    plain = hashing_encoder(8)

    def killed(texts):
        if any("37" in t for t in texts):
            raise RuntimeError("killed")
        return plain(texts)

    store = EmbeddedShards(spark, f"{tmp_path}/e")
    with pytest.raises(PySparkException):
        store.write(rows, "uid", "text", killed, 10, 2)
    assert store.manifest().read()["whole"] == [0, 1]
    with pytest.raises(ValueError):
        store.store()
    with pytest.raises(ValueError):
        store.write(rows, "uid", "text", plain, 20)
    assert store.write(rows, "uid", "text", plain, 10, 2) == [2, 3, 4] and store.write(rows, "uid", "text", plain, 10, 2) == []
    got = {r.uid: (r.shard, r.position, r.embedding) for r in store.store().rows().collect()}
    want = plain([f"word {k}" for k in range(50)]).astype(np.float32)
    assert len(got) == 50 and all(got[k][:2] == (k // 10, k % 10) and got[k][2] == want[k].tolist() for k in range(50))


def vectors(spark, a, b, d=8):
    x = np.random.default_rng(9).normal(size=(400, d)).astype(np.float32)
    return spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(a, b)], "uid long, embedding array<float>")


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_every_version_equals_a_batch_build(spark, tmp_path, kind):
    versions = IndexVersions(spark, f"{tmp_path}/v", kind, factor=1e6)
    queries = vectors(spark, 0, 20).withColumnRenamed("uid", "mention")
    ends = [100, 100, 130, 150, 350]
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        versions.add(vectors(spark, a, b) if b > a else spark.createDataFrame([], "uid long, embedding array<float>"), k)
        versions.add(vectors(spark, 0, 5), k)  # a batch that is run again changes nothing
        number, index = versions.open()
        assert number == k + 1 and index.vectors().count() == b
        want = {(r.mention, r["rank"], r.uid) for r in R.knn(queries, vectors(spark, 0, b), 4).collect()}
        assert {(r.mention, r["rank"], r.uid) for r in index.search(queries, 4).collect()} == want
    kept = versions.manifest()
    assert [kept.read(v)["trained_rows"] for v in kept.versions()] == [100, 100, 100, 100, 350]
    assert versions.open(3)[1].vectors().count() == 130
    versions.expire(1)
    assert kept.versions() == [5] and versions.open()[1].vectors().count() == 350


def test_a_stream_makes_versions_and_another_searches_them(spark, tmp_path):
    versions = IndexVersions(spark, f"{tmp_path}/v", "flat")
    search = RefreshingSearch(versions, f"{tmp_path}/found", 2, every=2)
    assert versions.open() == (0, None)
    arrivals, asked = f"{tmp_path}/a", f"{tmp_path}/q"
    queries = vectors(spark, 0, 30).withColumnRenamed("uid", "mention")
    for k in range(3):
        vectors(spark, 100 * k, 100 * k + 100).write.mode("append").parquet(arrivals)
        versions.refresh(spark.readStream.schema("uid long, embedding array<float>").parquet(arrivals), f"{tmp_path}/c1").awaitTermination()
        queries.where(F.col("mention") % 3 == k).write.mode("append").parquet(asked)
        search.start(spark.readStream.schema("mention long, embedding array<float>").parquet(asked), f"{tmp_path}/c2").awaitTermination()
    got = search.results().collect()
    assert {(r.batch, r.version) for r in got} == {(0, 1), (1, 1), (2, 3)} and len(got) == 60
    want = {(r.mention, r["rank"], r.uid) for r in R.knn(queries.where("mention % 3 = 2"), vectors(spark, 0, 300), 2).collect()}
    assert {(r.mention, r["rank"], r.uid) for r in got if r.batch == 2} == want


def test_candidates_by_address(spark, tmp_path):
    names = spark.createDataFrame([(10 * k, k % 3, f"name {k}", list(range(k))) for k in range(6)], "uid long, identifier long, name string, tokens array<int>")
    write_shards(names, f"{tmp_path}/s", ["uid"], 2)
    addresses = spark.createDataFrame([(10 * k, k) for k in range(6)], "uid long, row long")
    ranked = spark.createDataFrame([(0, 1, 1, 50), (0, 1, 2, 0), (0, 2, 1, 50), (0, 2, 2, 77), (1, 3, 1, 10)], "batch long, mention long, rank int, uid long")
    got = {(r.mention, r["rank"]): r for r in C.by_address(ranked, addresses, ShardStore(spark, f"{tmp_path}/s"), 101, 102, most=5).collect()}
    assert got[1, 1].encoded == [101, 0, 1, 2, 102] and got[1, 2].encoded == [101, 102, 0, 0, 0] and got[3, 1].encoded == [101, 0, 102]
    assert (got[1, 1].position, got[1, 2].position, got[2, 1].position) == (1, 0, 1)
    assert (got[2, 2].identifier, got[2, 2].name, got[2, 2].position, got[2, 2].encoded) == (-100, "", None, [101, 102, 0, 0, 0])


def test_pubtator_on_the_command_line(spark, tmp_path):
    from lexilink.__main__ import main

    spark.createDataFrame([(1, 0, "Title"), (1, 1, "Text")], "eid long, passage_id long, text string").write.parquet(f"{tmp_path}/passages")
    spark.createDataFrame([(1, 0, 5, "Title", "Gene", ["7"])], "eid long, start long, end long, text string, type string, ids array<string>").write.parquet(f"{tmp_path}/new")
    main(["pubtator", "--run", "input", "--dir", f"{tmp_path}/passages", "--out", f"{tmp_path}/a"])
    main(["pubtator", "--run", "append", "--dir", f"{tmp_path}/new", "--files", f"{tmp_path}/a", "--out", f"{tmp_path}/b"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/b").collect()] == ["1|t|Title", "1|a|Text", "1\t0\t5\tTitle\tGene\t7", ""]
    with pytest.raises(SystemExit):
        main(["pubtator", "--run", "append", "--dir", f"{tmp_path}/new", "--out", f"{tmp_path}/c"])


def test_runs_are_assembled_with_their_knowledge_bases(spark, tmp_path):
    from lexilink.sources import kb_source as B

    kbs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "kb string, uid long")
    B.assemble_runs(spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "corpus string, kb string"), kbs, f"{tmp_path}/r")
    assert sorted((r.corpus, r.uid) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [("x", 1), ("x", 2), ("y", 1), ("y", 2), ("z", 3)]
    with pytest.raises(PySparkException):
        B.assemble_runs(spark.createDataFrame([("x", "c")], "corpus string, kb string"), kbs, f"{tmp_path}/s")


def test_closed_sets(spark):
    from lexilink.sources.kb_source import domain

    rows = lambda v: spark.createDataFrame([(v,)], "v string").select(domain(F.col("v"), ["a", "b"], "kind").alias("v"))
    assert rows("a").first().v == "a"
    for v in ("c", None):
        with pytest.raises(PySparkException):
            rows(v).collect()
