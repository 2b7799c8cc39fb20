"""Stores, indexes, writers, settings and the errors that operators raise."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilink.functions import subwords as W
from lexilink.operators import abbreviations as A
from lexilink.operators import evaluation as E
from lexilink.operators import indexstore as I
from lexilink.operators import retrieval as R
from lexilink.operators import runs, settings
from lexilink.operators import textsim as X
from lexilink.sources import kb_source as K
from lexilink.sources import writers
from lexilink.sources.shards import ShardStore, write_shards


def vectors(spark, n=300, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "uid long, embedding array<float>"), x.astype(np.float32).astype(float)


def exact(x, q, k, metric):
    scores = R.score_block(q, x, metric)
    return [sorted(range(len(x)), key=lambda j, r=r: (-r[j], j))[:k] for r in scores]


@pytest.mark.parametrize(("kind", "metric", "opq"), [("flat", "l2", False), ("ivf", "l2", False), ("ivf", "ip", False), ("pq", "ip", True), ("ivfpq", "l2", False), ("ivfpq", "ip", True)])
def test_indexes_find_what_exact_search_finds(spark, tmp_path, kind, metric, opq):
    rows, x = vectors(spark)
    queries = rows.where("uid % 10 = 0").withColumnRenamed("uid", "mention")
    index = I.VectorIndex.build(rows.repartition(3), f"{tmp_path}/i", kind, metric, factor=5.0, codes=8, bits=6, opq=opq)
    assert index.vectors().count() == 300 and index.trained.factory == R.factory_string(kind, 300, 8, 6, opq)
    again = I.VectorIndex.open(spark, f"{tmp_path}/i")
    found = {(r.mention, r["rank"]): r.uid for r in again.search(queries, 5).collect()}
    want = exact(x, x[::10], 5, metric)
    right = sum(found.get((10 * m, k + 1)) in w for m, w in enumerate(want) for k in range(5))
    assert right >= 0.9 * 150 and (kind != "flat" or right == 150)


def test_an_index_is_reused_unless_overwritten(spark, tmp_path):
    rows, _ = vectors(spark, 50)
    path = f"{tmp_path}/i"
    assert I.VectorIndex.open(spark, path) is None
    I.VectorIndex.build(rows, path, "ivf")
    assert I.VectorIndex.build(rows.limit(3), path, "ivf").vectors().count() == 50
    assert I.VectorIndex.build(rows.limit(3), path, "ivf", overwrite=True).vectors().count() == 3
    assert I.VectorIndex.build(rows.limit(0), f"{tmp_path}/e", "flat").search(rows.withColumnRenamed("uid", "mention"), 3).count() == 0
    with pytest.raises(ValueError):
        I.VectorIndex.build(rows, path, "tree")


def test_running_top_equals_one_pass():
    rng = np.random.default_rng(3)
    scores, uids = np.round(rng.random((7, 200)), 1), rng.permutation(200)
    top = R.RunningTop(4)
    for at in range(0, 200, 33):
        r, c = R.best_of(scores[:, at : at + 33], uids[at : at + 33], 4)
        top.add(r, uids[at : at + 33][c], scores[:, at : at + 33][r, c])
    r, c = R.best_of(scores, uids, 4)
    assert list(zip(top.rows, top.uids, top.scores, strict=True)) == list(zip(r, uids[c], scores[r, c], strict=True))


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, list(range(i % 5))) for i in range(25)], "uid long, ids array<int>").repartition(4)
    write_shards(rows, f"{tmp_path}/s", ["uid"], 10)
    store = ShardStore(spark, f"{tmp_path}/s")
    assert store.shard_size() == 10 and {r.shard: r.n for r in store.sizes().collect()} == {0: 10, 1: 10, 2: 5}
    assert [r.uid for r in store.row(17).collect()] == [17] and store.row(99).count() == 0
    assert [[r.uid for r in s.collect()] for s in store.shards()] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    values, offsets = store.arrays(2, "ids")
    assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [list(range(i % 5)) for i in range(20, 25)]
    spark.createDataFrame([(99, [1], 0)], "uid long, ids array<int>, position long").write.mode("append").parquet(f"{tmp_path}/s/shard=0")
    with pytest.raises(ValueError):
        store.shard_size()


def test_best_names_of_distinct_texts(spark):
    kb = [("a", 3, "Alpha beta"), ("a", 1, "alpha BETA"), ("a", 2, "gamma"), ("b", 5, "zz"), ("b", 4, "alpha")]
    choices = spark.createDataFrame(kb, "key string, ord long, name string")
    mentions = spark.createDataFrame([(1, "a", "ALPHA"), (2, "a", "ALPHA"), (3, "b", "gamma"), (4, "a", "x"), (5, "c", "alpha")], "mention long, key string, text string")
    got = {r.mention: (r.ord, r.name, r.score > 0) for r in X.best_names(mentions, choices, X.inverse_frequencies(choices)).collect()}
    assert got == {1: (1, "alpha BETA", True), 2: (1, "alpha BETA", True), 3: (4, "alpha", False), 4: (1, "alpha BETA", False)}


def test_ambiguous_counts_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcd "), rng.integers(1, 9))).strip() for _ in range(120)] + ["", "é ü"]
    mentions = [(i, int(rng.integers(0, 3)), str(rng.choice(names))) for i in range(200)]
    choices = [(int(rng.integers(0, 3)), str(rng.choice(names))) for _ in range(60)]
    got = X.ambiguous_counts(spark.createDataFrame(mentions, "mention long, identifier long, text string"), spark.createDataFrame(choices, "identifier long, choice string"), (50, 80, 100)).first()
    best = [max((X.indel_ratio(t, c) for i, c in choices if i == identifier), default=0) for _, identifier, t in mentions]
    assert tuple(got) == tuple(sum(b >= t for b in best) for t in (50, 80, 100))


def test_headers_hold_across_blocks(spark):
    lines = ["7|text|with|bars", "AB|alpha beta|0.5", "x", "8|t", "12|twelve|0.25", "CD|c d|bad", "EF|e f|1.0"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, line string").repartition(3)
    for block in (2, 100):
        assert sorted(map(tuple, A.parse_extractor_output(df, block).collect())) == [(7, "AB", "alpha beta", 0.5), (8, "12", "twelve", 0.25), (8, "EF", "e f", 1.0)]


def test_remapping_is_sorted_and_in_document_offsets(spark):
    rows = spark.createDataFrame([(1, 0, 100, "b a b", ["b", "zz", "b"]), (1, 1, 0, None, None)], "doc long, passage_id long, offset long, text string, mentions array<string>")
    assert [tuple(r) for r in A.remap_mentions(rows).collect()] == [(1, 0, "b", 100, 101, 1), (1, 0, "b", 104, 105, 2)]


def test_spans_without_tokens_are_errors(spark):
    rows = W.tokenize(spark.createDataFrame([(1, "one two  three"), (2, None)], "k long, text string"), ["k"], "text", W.word_tokenizer())
    got = {r.k: (r.starts, r.ends) for r in rows.collect()}
    assert got == {1: ([0, 4, 9], [3, 7, 14]), 2: ([], [])}
    span = lambda a, b: rows.where("k = 1").select(W.token_span(F.lit(a), F.lit(b), F.col("starts"), F.col("ends")).alias("s")).first().s
    assert tuple(span(4, 14)) == (1, 2)
    for a, b in ((5, 7), (4, 8), (9, 3)):
        with pytest.raises(Exception, match="no tokens begin and end"):
            span(a, b)


def test_reconciliation(spark):
    predicted = spark.createDataFrame([(1, 0, 5, [10, 3]), (1, 9, 12, [3]), (2, 0, 5, [99])], "doc long, start long, end long, ids array<long>")
    gold = spark.createDataFrame([(1, 0, 5, "h1"), (2, 0, 5, "h2")], "doc long, start long, end long, hexdigest string")
    history = spark.createDataFrame([(10, 11)], "id long, new_id long")
    mapping = spark.createDataFrame([(11, "A"), (3, "B")], "id long, new_id string")
    assert {r.hexdigest: r.ids for r in E.reconcile_predictions(predicted, gold, history, mapping).collect()} == {"h1": ["A", "B"], "h2": ["NIL"]}


def test_settings():
    assert settings.load([], ["a.b=1", "a.c=x", "a.b=[2]"]) == {"a": {"b": [2], "c": "x"}}
    assert settings.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert settings.digest({"b": 1, "a": {"d": True}}) == settings.digest({"a": {"d": "True"}, "b": "1"}) != settings.digest({})
    assert settings.data_path("/r/", {"x": 1}, 3, True) == f"/r/{settings.digest({'x': 1})}/3/abbreviations"
    assert len(settings.expanded({"sentences": [True, False]})) == 12
    with pytest.raises(ValueError):
        settings.override("novalue")

    class Model:
        def forward_query(self):
            return 1

    assert settings.dispatch(Model(), "query")() == 1
    with pytest.raises(ValueError, match="query"):
        settings.dispatch(Model(), "other")


def test_settings_from_files(tmp_path):
    (tmp_path / "a.json").write_text('{"session": {"x": 1}, "k": 1}')
    (tmp_path / "b.json").write_text('{"session": {"y": 2}}')
    assert settings.load([f"{tmp_path}/a.json", f"{tmp_path}/b.json"], ["k=5"]) == {"session": {"x": 1, "y": 2}, "k": 5}


def test_files_of_unequal_length_are_errors(spark):
    parts = {"a": spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), "b": spark.createDataFrame([(1, "z")], "k long, b string")}
    with pytest.raises(Exception, match="b has no line 2"):
        runs.zipped(parts, "k").collect()


def test_types_without_kb_are_errors(spark):
    with pytest.raises(Exception, match="no knowledge base for planet"):
        K.knowledge_bases(spark.createDataFrame([("planet",)], "type string")).collect()


def test_xml_escapes_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "title", "a < b & c\x01"), (1, 1, "text", None)], "eid long, passage_id long, role string, text string")
    content = writers.bioc_xml_documents(rows).first().content
    assert "<text>a &lt; b &amp; c?</text>" in content and content.count("<passage>") == 2 and "<offset>11</offset>" in content


def test_command_line(spark, tmp_path, capsys):
    from lexilink.__main__ import main

    main(["enum_domain", "--dir", "/root/testdata/sf0.001", "--out", f"{tmp_path}/o", "--debug", "--set", "session.spark.sql.shuffle.partitions=3"])
    assert spark.read.parquet(f"{tmp_path}/o").count() == 5 and "Physical Plan" in capsys.readouterr().out


def test_uneven_arrays_and_unpaired_marks_are_errors(spark):
    from lexilink.operators import corpus as C

    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], [])], "k long, x array<int>, y array<string>")
    assert sorted(map(tuple, C.split_arrays(df, "k", ["x", "y"]).collect())) == [(1, 1, "a"), (1, 2, "b")]
    with pytest.raises(Exception, match="different lengths in 3"):
        C.split_arrays(df.union(spark.createDataFrame([(3, [1], [])], df.schema)), "k", ["x", "y"]).collect()
    marked = spark.createDataFrame([([1, 7, 2],), ([1, 7],)], "t array<int>")
    assert marked.where("size(t) = 3").select(C.extract_mentions(F.col("t"), 1, 2).alias("m")).first().m == [[7]]
    with pytest.raises(Exception, match="don't pair"):
        marked.select(C.extract_mentions(F.col("t"), 1, 2).alias("m")).collect()


def test_bioc_json_collections_are_files_or_lines(spark, tmp_path):
    passages = spark.createDataFrame([(e, k, f"p{k}\nof {e}") for e in range(20) for k in range(2)], "eid long, passage_id int, text string")
    marks = spark.createDataFrame([(3, 1, 0, 2, "p1", "t", "x")], "eid long, passage_id int, start long, end long, text string, type string, identifier string")
    documents = writers.bioc_json_collections(passages, marks)
    found = []
    for lines in (False, True):
        path = f"{tmp_path}/{lines}"
        writers.write_contents(documents.coalesce(1), path, per_file=0 if lines else 1)
        assert len(list(Path(path).glob("part-*"))) == (1 if lines else 20)
        found.append([sorted(map(tuple, t.collect())) for t in writers.read_bioc_json(spark, path, lines=lines)])
    assert found[0] == found[1] and len(found[0][0]) == 40 and found[0][1] == [("3", 1, 0, 2, "p1", "t", "x")]


def test_document_files_are_as_many_as_tasks(spark, tmp_path, monkeypatch):
    from lexilink.plans import store_plans

    monkeypatch.setattr(store_plans, "_path", lambda spark, what: f"{tmp_path}/{what}")
    n = store_plans.document_files(spark, "/root/testdata/sf0.01").count()
    assert n > 50 and len([p for p in (tmp_path / "documents").rglob("*") if p.is_file() and p.suffix != ".crc"]) < 20


@pytest.mark.parametrize("each", [False, True])
def test_named_documents_come_back(spark, tmp_path, each):
    rows = [(1, 'a "title"\n\nrest \\   é\r and'), (22, "\n\n"), (3, "x\ty\x85\n\nb")] + ([] if each else [(4, "form\ffeed\n\n")])
    writers.write_named(spark.createDataFrame(rows, "eid long, content string"), f"{tmp_path}/d", each)
    assert sorted((int(r.eid), r.content) for r in writers.read_named(spark, f"{tmp_path}/d", each).collect()) == sorted(rows)
    assert (tmp_path / "d" / "eid=22").is_dir() == each
