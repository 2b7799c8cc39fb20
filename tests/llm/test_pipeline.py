"""Every stage of the pipeline against a brute-force version, on the smallest tables and on planted cases."""

import corpus_pipeline
import pytest
from test_decontaminate import brute as contaminated
from test_jaccard import WORD as SPACED
from test_linededup import brute as lines
from test_packing import ids
from test_quality import brute as counts

from lexilink.llm.common import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(after[k] == before[k] for k in after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for doc, text in before.items():
        n, *_, repeated = counts(text)
        failed = n < 50 or 100 * repeated > 50 * n
        assert not (failed and doc in after)
        if labels.get(doc) == 1 and not failed:
            assert doc in after
        if labels.get(doc) == 0:
            assert doc not in after


def test_line_dedup(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = lines(list(before.items()))
    assert before.keys() == after.keys()
    for r in stages[2].collect():
        assert r.text.count("\n") + 1 == max(1, want[r.doc_id][0] - want[r.doc_id][1]) and r.n_chars == len(r.text)


def test_near_duplicates(stages):
    rows = sorted(texts(stages[2]).items())
    sets = {}
    for doc, text in rows:
        w = SPACED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert set(texts(stages[3])) == {d for d in docs if find(d) == d}


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before = texts(stages[3])
    bad = {row[0] for row in contaminated(list(before.items()), items) if row[-1]}
    assert texts(stages[4]).keys() == before.keys() - bad


def test_packing(stages):
    got = stages[5].toPandas()
    want = {doc: len(ids(text)) for doc, text in texts(stages[4]).items()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert (got.groupby("bin_id").n_tokens.sum() <= got.groupby("bin_id").capacity.first()).all()


def test_stages_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = docs.limit(3).union(spark.createDataFrame([(10**6, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, DIR).collect()
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_stages_take_clashing_names_repeated_rows_and_long_texts(spark):
    """Each stage alone: no column is lost or overwritten, rows of one id are judged by their own texts, clean documents stay."""
    clean = " ".join(f"word{i}a" for i in range(400))
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    texts_of = [(1, clean), (1, clean + " " + item), (1, clean), (2, clean.replace("word7a", "other")), (None, clean[::-1]), (None, None), (3, "very long " * 200_000), (4, "\n".join([clean[:300]] * 5)), (5, clean[:300]), (6, clean[:300])]
    names = ["__doc", "_doc", "_mark", "__share", "_drops", "llm_n_lines", "rid", "row", "id", "n_words", "tokens"]
    rows = [(d, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(texts_of)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        left[name] = sorted(int(r["__doc"][5:]) for r in out.collect())
        assert all(r[n] == n + r["__doc"][5:] for r in out.collect() for n in names)
    assert left["line_dedup"] == list(range(10))
    near = left["ngram_jaccard_join"]
    assert len([i for i in near if i in (0, 1, 2, 3)]) == 1 and {4, 5, 6} <= set(near)
    assert left["benchmark_decontamination"] == [0, 2, 3, 4, 5, 6, 7, 8, 9]
    assert not {5, 6} & set(left["quality_rules"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert packed.n_tokens.sum() == sum(len(ids(t)) for _, t in texts_of)
