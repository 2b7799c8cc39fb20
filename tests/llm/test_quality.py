import re

import numpy as np
import pyarrow as pa
import pytest

from lexilink.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x y z\nx y z\n\nx y z ", "é ü\u00a0w # $$ <b>\n", "a a a a a", "\nq\nq\n", "A b c\na b c", "w " * 3000 + "\n", "ß" * 70000 + " end"]


def test_counts_equal_brute_force():
    got = quality.count_statistics(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert tuple(int(got[k][i]) for k in quality.COUNTS) == brute(text), repr(text)[:40]


def test_counts_of_slices_and_random_texts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \n#é"), rng.integers(0, 60))) for _ in range(400)]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    got = quality.count_statistics(column)
    for i, text in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality.COUNTS) == brute(text), repr(text)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 3))
    forest = quality.IsolationForest().fit(x)
    assert forest.score(np.full((5, 3), 9.0)).min() > np.quantile(forest.score(x), 0.99)


def test_rules_on_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_rules(docs.withColumn("score", docs.doc_id), labels).join(labels, "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    bad = got[got.quality == 0]
    assert good.kept.mean() > 0.97
    assert bad.kept.mean() < 0.1


def test_nulls_empty_tables_and_no_labels(spark):
    schema = "doc_id long, text string, kept int"
    docs = spark.createDataFrame([(1, None, 1), (None, "w " * 60, 2), (3, "a b", 3), (3, "a b", 3)], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == 4 and {r.n_words for r in rows} == {0, 60, 2}
    assert not any(r.kept for r in rows)
    assert quality.quality_rules(spark.createDataFrame([], schema), labels).count() == 0


@pytest.mark.parametrize("text", ["a b", "|x |y"])
def test_base_failed_short(text):
    counts = quality.count_statistics(pa.array([text]))
    assert quality.base_failed(counts["n_words"], counts["n_repeat_words"])[0]


def walked(forest, row):
    """The mean path of one row, node by node."""
    total = 0.0
    for feature, cut, left, right, path, _ in forest.nodes:
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < cut[at] else right[at]
        total += path[at]
    return total / len(forest.nodes)


def test_verdicts_equal_trees_walked_row_by_row(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(quality.statistics(docs), quality.sampled_labels(labels, "doc_id", "quality", 40_000))
    rows = docs.collect()
    counts = quality.count_statistics(pa.array([r.text for r in rows], pa.string()))
    x = quality.features(counts)
    usual = float(model[0].usual_path(model[0].per_tree))
    want = {}
    for i, r in enumerate(rows):
        n, *_, repeated = brute(r.text)
        score = 2.0 ** (-walked(model[0], x[i]) / usual)
        want[r.doc_id] = not (n < 50 or 100 * repeated > 50 * n) and score <= model[1]
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()} == want
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {k for k, v in want.items() if v}
    assert 0 < sum(want.values()) < len(want)


def test_labels_are_bounded_before_they_travel(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").unionByName(spark.createDataFrame([(None, 1), (7, None), (7, 0)], "doc_id long, quality int"))
    found = quality.sampled_labels(labels, "doc_id", "quality", 100).collect()
    assert len(found) == 100 and len({r.doc_id for r in found}) == 100
    smallest = [r.doc_id for r in spark.range(5000).selectExpr("id AS doc_id", "xxhash64(id) AS h").orderBy("h").limit(100).collect()]
    assert {r.doc_id for r in found} == set(smallest)


def test_few_labels_leave_the_base_rules(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(60))) for i in range(30)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 30
    assert quality.fit(quality.statistics(docs), quality.sampled_labels(labels, "doc_id", "quality", 50), least_good=5) is not None
