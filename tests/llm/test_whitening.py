import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilink.llm.whitening import add_rows, centred, deviations, outer_sums, two_sum, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<float>"


def whole(vectors, scale=64, shift=1_000_000):
    return [[math.floor(scale * float(np.float32(c))) + shift for c in v] for v in vectors]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    return sums, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def test_error_free_sums():
    rng = np.random.default_rng(0)
    high = rng.normal(size=(101, 3)) * 10.0 ** rng.integers(-12, 12, (101, 3))
    s, e = add_rows(*two_sum(high, np.zeros_like(high)))
    for k in range(3):
        want = sum(map(Fraction, high[:, k].tolist()))
        assert abs(Fraction(float(s[k])) + Fraction(float(e[k])) - want) <= abs(want) * Fraction(1, 10**25) + Fraction(1, 10**18)


def test_products_of_centred_entries_beyond_double_precision():
    rng = np.random.default_rng(1)
    x = rng.integers(10**9, 10**9 + 5, (67, 4))
    sums, want = exact_covariance(x.tolist())
    i, j = np.triu_indices(4)
    high, low = outer_sums(*centred(x, sums, len(x)), i, j)
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        found = (Fraction(float(high[k])) + Fraction(float(low[k]))) / len(x)
        assert abs(found - want[a][b]) <= Fraction(1, 10**24) * max(1, abs(want[a][b]))


def brute(vectors):
    x = whole(vectors)
    sums, v = exact_covariance(x)
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    return x, sums, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_exact_arithmetic(spark, parts):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 6)) @ np.diag([3, 2, 1, 0.5, 0.3, 0.2])).astype(np.float32)
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:1] + [(None, rows[1][1])], SCHEMA).repartition(parts).withColumn("component", F.lit("theirs"))
    used = [*vectors, vectors[0], vectors[1]]
    x, sums, e, u = brute(used)
    n = len(used)
    out = whitened_components(df, components=4)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 4 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    z = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    want = z @ u / np.sqrt(e)
    sign = {}
    for r in got:
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[r["vec_id"] if r["vec_id"] is not None else 1], sums, strict=True))
        k = r["component"] - 1
        w = want[r["vec_id"] if r["vec_id"] is not None else 1, k]
        if abs(w) > 1e-3:
            sign.setdefault(k, np.sign(w) * np.sign(r["whitened"]))
            assert abs(sign[k] * r["whitened"] - w) < 1e-9
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_whitened_covariance_is_the_identity(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found, model = whiten(df)
    w = np.array([r["whitened"] for r in found.select("whitened").collect()])
    assert w.shape == (df.count(), 32)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9 and model.identity_error < 1e-9


def test_flat_directions_and_single_rows(spark):
    rows = [(k, [float(k), 1.0, 2.0 * k]) for k in range(10)]
    got = whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 30 and all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-9
    one = whitened_components(spark.createDataFrame([(7, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]


def test_no_usable_vectors(spark):
    for rows in ([], [(1, None), (2, [float("nan")])]):
        out = whitened_components(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.schema["n"].dataType.simpleString() == "bigint"


def test_huge_entries(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 2.0])]
    got = whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 2)


def test_deviations_leave_64_bits_behind():
    from lexilink.llm.whitening import Whitening

    model = Whitening(1, 3, [3], np.eye(1), np.ones(1), np.eye(1), 0.0, 64, 0)
    assert deviations(np.array([[2**33], [1], [-(2**33)]]), model) == [None, 0, None]
    assert deviations(np.array([[5], [1]]), model) == [144, 0]
