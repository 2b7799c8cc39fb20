"""N-D padding, stacking and checked regrouping against numpy and by error."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexilink.functions import arrays as Y
from lexilink.operators import corpus as C

CUBES = [(1, 0, [[[1, 2], [3, 4]]]), (1, 1, [[[5]], [[6]], [[7]]]), (2, 0, [[[8, 9, 10]]]), (2, 1, []), (3, 0, [[]])]


def cube_rows(spark):
    return spark.createDataFrame(CUBES, "batch long, k long, a array<array<array<long>>>")


def numpy_padded(values, shape, left):
    x = np.array(values, np.int64).reshape(tuple(np.array(values).shape) + (0,) * (3 - np.array(values).ndim)) if np.array(values).size == 0 else np.array(values)
    width = [((n - m, 0) if left else (0, n - m)) for n, m in zip(shape, x.shape, strict=True)]
    return np.pad(x, width, constant_values=-1).tolist()


@pytest.mark.parametrize("left", [False, True])
def test_three_dimensions_like_numpy(spark, left):
    shapes = {1: (3, 2, 2), 2: (1, 1, 3)}
    got = {(r.batch, r.k): r.a for r in Y.pad_batches(cube_rows(spark), ["batch"], "a", -1, left).collect()}
    for batch, k, values in CUBES[:4]:
        assert got[batch, k] == numpy_padded(values, shapes[batch], left)
    assert got[3, 0] == [[]]


def test_shapes_and_columns_stay(spark):
    rows = cube_rows(spark)
    assert [r.s for r in rows.select(Y.shape(F.col("a"), 3).alias("s")).collect()] == [[1, 2, 2], [3, 1, 1], [1, 1, 3], [0, 0, 0], [1, 0, 0]]
    done = Y.pad_batches(rows.withColumn("width", F.lit("theirs")), ["batch"], "a")
    assert done.columns == ["batch", "k", "a", "width"] and done.schema["a"].dataType == rows.schema["a"].dataType
    assert Y.pad_batches(rows.limit(0), ["batch"], "a").count() == 0


@pytest.mark.parametrize("values", [[[[1, 2], [3]]], [[[1]], [[1], [2]]], [None], [[None]], None])
def test_ragged_and_null_arrays_are_errors(spark, values):
    rows = spark.createDataFrame([(1, values)], "batch long, a array<array<array<long>>>")
    with pytest.raises(PySparkException):
        Y.pad_batches(rows, ["batch"], "a").collect()


def test_stacks_and_empty_batches(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2]), (1, 0, [3]), (None, 0, [4])], "batch long, k long, a array<int>")
    done = Y.stacked(rows.where("batch IS NOT NULL").select("batch"), rows, ["batch"], ["k"], "a", 0).collect()
    assert [(r.batch, r.a, r["shape"]) for r in done] == [(1, [[3, 0], [1, 2]], [2, 2])]
    with pytest.raises(PySparkException):
        Y.stacked(spark.createDataFrame([(1,), (9,)], "batch long"), rows, ["batch"], ["k"], "a").collect()


def test_mixed_ranks_are_errors(spark):
    good = spark.createDataFrame([("[[1, 2], [3, 4]]",), (" [ [5] ]",), (None,)], "t string")
    assert [r.a for r in good.select(Y.parsed(F.col("t"), 2).alias("a")).collect()] == [[[1, 2], [3, 4]], [[5]], None]
    for text in ("[1]", "[[[1]]]", "x"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(text,)], "t string").select(Y.parsed(F.col("t"), 2)).collect()


EXAMPLE = "row long, idx long, eid long, passage_id long, tokens array<int>, offsets array<array<long>>, identifiers array<array<long>>, ids array<array<long>>"


def test_examples_are_regrouped_where_the_ordinal_changes(spark):
    rows = [
        (0, 0, 7, 0, [1], [[0, 1], [2, 3]], [[5], [6, 7]], [[1], [2]]),
        (1, 0, 7, 1, [2], [], [], []),
        (2, 1, 8, 0, [3], [], [], []),
        (3, 0, 9, 0, [4], [[0, 1]], [[5]], [[1]]),  # the ordinal comes back: an example of its own
    ]
    got = {r.eid: r for r in C.checked_examples(spark.createDataFrame(rows, EXAMPLE).repartition(3)).collect()}
    assert sorted(got) == [7, 8, 9]
    assert got[7].passage_ids == [0, 1] and got[7].tokens == [[1], [2]] and got[7].offsets == [[[0, 1], [2, 3]], [[-1, -1]]]
    assert got[7].identifiers == [[[5, -1], [6, 7]], [[-1]]] and got[7].ids == [[[1], [2]], [[-1]]]


@pytest.mark.parametrize("second", [(1, 0, 8, 1, [2], [], [], []), (1, 0, 7, 1, [2], [[0, 1]], [], []), (1, 0, 7, 1, [2], [[0, 1]], [[4]], [])])
def test_mixed_documents_and_uneven_mentions_are_errors(spark, second):
    with pytest.raises(PySparkException):
        C.checked_examples(spark.createDataFrame([(0, 0, 7, 0, [1], [], [], []), second], EXAMPLE)).collect()


def test_mentions_stand_where_their_places_say(spark):
    passages = [(1, 0, "A title."), (1, 1, "Some abstract."), (1, 2, "More text."), (2, 0, "Only one"), (3, 0, None), (3, 1, "b")]
    begin = {(1, 0): 0, (1, 1): 9, (1, 2): 24, (2, 0): 0, (3, 1): 1}
    words = [(eid, pid, begin[eid, pid] + t.find(w), begin[eid, pid] + t.find(w) + len(w), w) for eid, pid, t in passages if t for w in t.rstrip(".").split(" ")]
    p, a = spark.createDataFrame(passages, "eid long, passage_id long, text string"), spark.createDataFrame(words, "eid long, passage_id long, start long, end long, mention string")
    got = {(r.eid, r.part): (r.text, r.mentions) for r in C.whole_texts(p, a).collect()}
    assert {k: t for k, (t, _) in got.items()} == {(1, 0): "A title. Some abstract.", (1, 1): "More text.", (2, 0): "Only one", (3, 0): " b"}
    assert sum(len(m) for _, m in got.values()) == len(words)
    assert all(text[m.start : m.end] == m.mention for text, found in got.values() for m in found)
    apart = {(r.eid, r.part): (r.text, r.mentions) for r in C.whole_texts(p, a, title_abstract=False).collect()}
    assert len(apart) == 6 and all(text[m.start : m.end] == m.mention for text, found in apart.values() for m in found)


def test_mentions_keep_all_their_identifiers(spark):
    rows = spark.createDataFrame([("h1", "x", False, [3, 1]), ("h2", "y", True, [9])], "hexdigest string, text string, is_foreign boolean, identifiers array<long>")
    known = spark.createDataFrame([(1, 10), (3, 30)], "identifier long, id long")
    assert [tuple(r) for r in C.collected_mentions(rows, known).collect()] == [("h1", "x", ["30", "10"])]
    with pytest.raises(PySparkException):
        C.collected_mentions(rows.withColumn("is_foreign", F.lit(False)), known).collect()


def test_spans_meet_their_tokens_without_a_shuffle(spark):
    from lexilink.operators import corpus as C

    texts = spark.createDataFrame([(1, "ab  c"), (2, None), (3, ""), (4, "\u00e9x yz "), (1, "q")], "k long, text string")
    t = C.token_offsets(texts, ["k"], "text")
    assert sorted((r.k, r.words, r.starts, r.ends) for r in t.collect()) == [
        (1, ["ab", "", "c"], [0, 3, 4], [2, 3, 5]), (1, ["q"], [0], [1]), (3, [""], [0], [0]), (4, ["\u00e9x", "yz", ""], [0, 3, 6], [2, 5, 6])]
    tokens = C.tokens_with_offsets(texts.where("k = 4"), ["k"], "text").collect()
    assert [tuple(r) for r in tokens] == [(4, 0, "\u00e9x", 0, 2), (4, 1, "yz", 3, 5), (4, 2, "", 6, 6)]
    rows = [(1, [0, 3], [2, 5], [(0, 5), (3, 2), (-1, 9), (2, 4)]), (2, [0], [4], []), (3, [0, 2, 7], [1, 6, 9], [(7, 9), (0, 6)]), (4, [], [], [(0, 0)]), (5, [0], [3], None)]
    found = C.char_to_token_spans(spark.createDataFrame(rows, "k long, starts array<long>, ends array<long>, spans array<struct<start:long,end:long>>").coalesce(1), ["k"])
    assert [tuple(r) for r in found.collect()] == [(1, 0, 5, 0, 1), (1, 3, 2, 1, 0), (1, -1, 9, None, None), (1, 2, 4, None, None), (3, 7, 9, 2, 2), (3, 0, 6, 0, 1), (4, 0, 0, None, None)]
    assert "Exchange" not in C.char_to_token_spans(t.selectExpr("*", "array(struct(0L AS start, 1L AS end)) AS spans"), ["k"])._jdf.queryExecution().toString()
