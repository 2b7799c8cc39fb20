"""Worked vectors, properties and edge cases of single operators."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexilink.functions import text as T
from lexilink.functions.encoder import Projection
from lexilink.operators import abbreviations as A
from lexilink.operators import candidates as C
from lexilink.operators import corpus as K
from lexilink.operators import evaluation as E
from lexilink.operators import homonyms as H
from lexilink.operators import indexstore as I
from lexilink.operators import retrieval as R
from lexilink.operators import sharding as S
from lexilink.operators import textsim as X
from lexilink.sources import pubtator as P


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé ", max_size=30), st.text("abcdé ", max_size=30))
def test_indel_ratio_is_lcs(a, b):
    want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    assert X.indel_ratio(a, b) == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.integers(1, 20))
def test_chunk_sizes(total, parts):
    sizes = S.chunk_sizes(total, parts)
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_near_equal_chunk_is_ntile(spark):
    for total in (0, 1, 6, 7, 8, 100):
        df = spark.range(total).withColumn("c", S.near_equal_chunk(F.col("id"), F.lit(total), 7))
        want = [k + 1 for k, n in enumerate(S.chunk_sizes(total, 7)) for _ in range(n)]
        assert [r.c for r in df.orderBy("id").collect()] == want


def test_top_k_of_any_sharding_is_global():
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(5, 8)), rng.normal(size=(200, 8))
    v[50:60] = v[0]
    uids = rng.permutation(200)
    whole = R.best_of(R.score_block(q, v, "ip"), uids, 12)
    want = [[int(uids[c]) for r, c in zip(*whole, strict=True) if r == m] for m in range(5)]
    for shards in (2, 7):
        pool = [[] for _ in range(5)]
        for s in range(shards):
            part = np.arange(s, 200, shards)
            scores = R.score_block(q, v[part], "ip")
            for r, c in zip(*R.best_of(scores, uids[part], 12), strict=True):
                pool[r].append((-scores[r, c], int(uids[part][c])))
        assert [[u for _, u in sorted(p)[:12]] for p in pool] == want


def test_ivf_reaches_flat(spark):
    from lexilink.sources import fixtures

    d = "/root/testdata/sf0.01"
    q, index = fixtures.query_vectors(spark, d), fixtures.kb_vectors(spark, d)
    flat = {(r.mention, r.uid) for r in R.knn(q, index, 10).collect()}
    near = {(r.mention, r.uid) for r in I.knn_ivf(q, index, 10, factor=3.5).collect()}
    assert len(flat & near) / len(flat) >= 0.9
    every = {(r.mention, r.uid) for r in I.knn_ivf(q, index, 10, factor=100.0).collect()}
    assert every == flat


def test_factory_strings_and_parameters():
    assert R.ivf_parameters(10_000, 2.0) == (100, 20) and R.ivf_parameters(0) == (1, 1)
    assert R.factory_string("ivf", 10_000) == "IVF100,Flat" and R.factory_string("flat", 5) == "Flat"
    assert R.factory_string("ivfpq", 10_000, opq=True) == "OPQ16,IVF100,PQ16x8" == R.factory_string("ivfpf", 10_000, opq=True)
    with pytest.raises(ValueError):
        R.factory_string("hnsw", 1)


def test_recall_worked_vectors(spark):
    pred = spark.createDataFrame([(0, k + 1, i) for k, i in enumerate([8, 5, 2, 7, 9])], "mention long, rank int, identifier long")
    gold = spark.createDataFrame([(0, [1, 5, 6, 4, 3])], "mention long, gold array<long>")
    assert E.recall_at(pred, gold, [1, 3]).first() == (1, 0, 1)
    with pytest.raises(Exception, match="no prediction"):
        E.multi_label_recall(pred.select("mention", "rank", F.array("identifier").alias("ids")), gold.union(spark.createDataFrame([(9, [1])], gold.schema)), 1, "strict").collect()


def test_unique_name_rendering(spark):
    c = "\x1f"
    rows = [("n", ""), ("n", f"F:cat{c}"), ("n", f"F:cat{c}D:dog{c}"), ("n", f"D:a{c}D:b{c}"), ("n", f"F:{c}"), ("n", f"F:x{c}A:y"), ("n", f"D:k:v{c}")]
    df = spark.createDataFrame(rows, "name string, d string").coalesce(1)
    got = [r[0] for r in df.select(H.unique_name(F.col("name"), F.col("d"))).collect()]
    assert got == ["n", "n (cat)", "n (dog,cat)", "n (b)", "n ()", "n (y,x)", "n (k:v)"]


def test_disambiguation_with_nulls_and_unknown_foreign_ids(spark):
    rows = [(1, 1, "a", 0, 1, ""), (2, 2, "a", 0, 2, ""), (3, 3, "a", 1, 9, ""), (4, 1, "sym", 0, 1, ""), (5, 3, "b", 1, None, "")]
    kb = spark.createDataFrame(rows, "uid long, identifier long, name string, description int, foreign_identifier long, disambiguation string")
    fi = spark.createDataFrame([(1, "cat"), (2, None)], "foreign_identifier long, foreign_name string")
    got = {r.uid: r.disambiguation for r in H.disambiguate(kb, fi).collect()}
    assert got == {1: "F:cat\x1f", 2: "F:\x1f", 3: "", 4: "", 5: ""}
    assert H.unique_violations(H.disambiguate(kb, None)).count() == 1


def naive_global(local, sims, most):
    out = {}
    for m, own in local.items():
        pool = {u for us in local.values() for u in us} - set(own)
        ranked = [sorted(pool, key=lambda u, l=l: (-sims[l][u], u)) for l in own]
        seen = []
        for i in range(len(pool)):
            for r in ranked:
                if r[i] not in seen:
                    seen.append(r[i])
        out[m] = seen[:most]
    shortest = min(map(len, out.values()))
    return {m: v[:shortest] for m, v in out.items()}


def test_global_candidates_equal_naive_loop(spark):
    rnd = random.Random(4)
    vec = {u: [rnd.uniform(-1, 1) for _ in range(4)] for u in range(12)}
    sims = {a: {b: round(sum(x * y for x, y in zip(vec[a], vec[b], strict=True)), 9) for b in vec} for a in vec}
    local = {m: rnd.sample(range(12), 3) for m in range(4)}
    df = spark.createDataFrame([(0, m, k + 1, u) for m, us in local.items() for k, u in enumerate(us)], "doc long, mention long, rank int, uid long")
    vectors = spark.createDataFrame(list(vec.items()), "uid long, embedding array<double>")
    got = {}
    for r in C.global_candidates(df, vectors, 5).orderBy("mention", "rank").collect():
        got.setdefault(r.mention, []).append(r.uid)
    assert got == naive_global(local, sims, 5)


def test_padding_and_special_tokens(spark):
    df = spark.createDataFrame([([5, 6, 0, 0],), ([0, 0, 0, 0],), ([1, 2, 3, 4],)], "t array<int>").coalesce(1)
    assert [r[0] for r in df.select(K.add_special_tokens(F.col("t"), 101, 102)).collect()] == [[101, 5, 6, 102, 0, 0], [101, 102, 0, 0, 0, 0], [101, 1, 2, 3, 4, 102]]
    assert [r[0] for r in df.select(K.pad(F.filter("t", lambda x: x > 4), 3, "left")).collect()] == [[-1, 5, 6], [-1, -1, -1], [-1, -1, -1]]


def test_natural_key_and_sanitiser(spark):
    names = ["a10b2", "a2b10", "a2b9", "b1", "a", "10", "9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["9", "10", "a", "a2b9", "a2b10", "a10b2", "b1"]
    bad = spark.createDataFrame([("a\x00b\tc\x1fd\ufffe\U0001f600",)], "n string")
    assert bad.select(T.sanitize_xml(F.col("n"))).first()[0] == "a?b\tc?d?\U0001f600"


def test_schwartz_hearst():
    assert A.extract_pairs("multiple sclerosis (MS) and tumor necrosis factor alpha (TNF-a; old)") == [("MS", "multiple sclerosis"), ("TNF-a", "tumor necrosis factor alpha")]
    assert A.extract_pairs("nothing (see below) or (12)") == [] and A.extract_pairs(None) == []


def test_relocation_keeps_order():
    assert A.relocate("cat cats cat", ["cat", "cat", "cat", ""]) == [(0, 3), (9, 12), None, None]


def test_relocation_makes_no_pattern_for_each_mention(monkeypatch):
    import random
    import re

    def by_pattern(text, mentions):
        out, at = [], 0
        for m in mentions:
            found = re.compile(rf"(?<!\w){re.escape(m)}(?!\w)").search(text, at) if m else None
            out.append(found.span() if found else None)
            at = found.end() if found else at
        return out

    draw = random.Random(3)
    some = lambda n: "".join(draw.choice("ab_ -\u00e9\u0301\u00b2(") for _ in range(n))
    cases = [(some(40), [some(draw.randint(0, 3)) for _ in range(8)]) for _ in range(500)]
    expected = [by_pattern(*c) for c in cases]
    monkeypatch.setattr(A.re, "compile", lambda *_: pytest.fail("a pattern was compiled"))
    assert [A.relocate(*c) for c in cases] == expected


def test_pubtator_round_trip(spark, tmp_path):
    text = "7|t|A title.\n7|a|Some | text.\n7\t0\t1\tA\tGene\tTax:1|MESH:D2,-\n7\tAssoc\t1\t2\tNovel\n\n8|t|B.\n8|a|\n8\t0\t1\tB\tSpecies\t*9606\n8\t0\t1\tB\tSpecies\t\n"
    (tmp_path / "x.PubTator").write_text(text)
    texts, annotations = P.read_pubtator(spark, f"file://{tmp_path}/x.PubTator")
    assert {(r.pmid, r.kind, r.text) for r in texts.collect()} == {(7, "t", "A title."), (7, "a", "Some | text."), (8, "t", "B."), (8, "a", "")}
    assert sorted((r.pmid, r.start, r.type, tuple(r.ids)) for r in annotations.collect()) == [(7, 0, "Gene", ("1", "D2")), (8, 0, "Species", ()), (8, 0, "Species", ("9606",))]
    passages = texts.withColumn("passage_id", F.when(F.col("kind") == "t", 0).otherwise(1)).withColumnRenamed("pmid", "eid")
    assert {tuple(r) for r in P.format_documents(passages).collect()} == {(7, "7|t|A title.", "7|a|Some | text."), (8, "8|t|B.", "8|a|")}


def test_projection_is_normalised():
    out = Projection.seeded(8, 4)(np.random.default_rng(0).normal(size=(3, 8)))
    assert np.allclose(out.mean(axis=1), 0) and np.allclose(out.std(axis=1), 1, atol=1e-3)


def test_marginal_nll_drops_mentions_without_gold(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 0.0, 0), (2, 5.0, 0), (3, 1.0, 1)], "mention int, score double, label int")
    assert {r.mention: round(r.nll, 6) for r in C.marginal_nll(df).collect()} == {1: 0.693147, 3: 0.0}


def test_document_scores(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "doc int, id string")
    pred = spark.createDataFrame([(1, "a"), (9, "z")], "doc int, id string")
    r = E.document_prf(gold, pred).first()
    assert (r.precision, r.recall) == (50.0, 25.0) and r.f1 == pytest.approx(33.333333)
    assert E.document_prf(gold, pred.limit(0)).first().f1 == 0.0


def test_global_row_number_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "c", "a", "é", ""]], "s string").repartition(3)
    rows = S.global_row_number(df, ["s"]).orderBy("row").collect()
    assert [r.s for r in rows] == [None, "", "a", "a", "b", "c", "é"] and [r.row for r in rows] == list(range(7))
    assert S.global_row_number(df.limit(0), ["s"]).count() == 0
