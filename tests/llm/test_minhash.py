import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilink.llm import minhash
from lexilink.llm.minhash import band_keys, band_rows, near_duplicates, signatures

from test_jaccard import brute, near_copies


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("component_id", F.lit("theirs")).withColumn("key", F.lit(0))
    out = near_duplicates(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()}


def reference(seeds, m):
    """The signature by the definition, one shingle after another, with a permutation for each."""
    from lexilink.llm.wordbytes import mix

    values = [None] * m
    for s in seeds.tolist():
        places = list(range(m))
        for step in range(m):
            drawn = int(mix(np.array([(s + (step + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            at = step + ((drawn >> 32) * (m - step) >> 32)
            places[step], places[at] = places[at], places[step]
            value = (step << 32) | (drawn & 0xFFFFFFFF)
            if values[places[step]] is None or value < values[places[step]]:
                values[places[step]] = value
    return values


@pytest.mark.parametrize("m", [16, 256])
def test_signatures_follow_the_definition(m):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 10, 40, 300)]
    got = signatures(sets, m)
    for row, s in zip(got.tolist(), sets, strict=True):
        assert row == reference(s, m)
    assert (signatures([np.zeros(0, np.uint64)], m) == np.uint64(2**64 - 1)).all()


def test_agreement_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        union = rng.integers(0, 2**63, 40, dtype=np.uint64)
        a, b = signatures([np.sort(union[:36]), np.sort(union[4:])], 256)
        errors.append((a == b).mean() - 32 / 40)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.7 * np.sqrt(0.8 * 0.2 / 256)  # that of independent hashes


def test_linked_pairs_share_a_band():
    rows = band_rows(85, 256)
    assert rows == 6 and (1 - 0.85**rows) ** (256 // rows) < 1e-8
    rng = np.random.default_rng(2)
    for n in (7, 20, 100, 1000):
        for _ in range(60):
            union = rng.integers(0, 2**63, n, dtype=np.uint64)
            apart = int(0.15 * n)
            a, b = band_keys(signatures([np.sort(union[: n - apart // 2]), np.sort(union[apart - apart // 2 :])], 256), rows)
            assert (a == b).any()


def test_near_copies_equal_brute_force(spark):
    rows = near_copies(3)
    want = brute(rows, n=3)
    assert found(spark, rows) == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert found(spark, rows, cell_tokens=400) == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_groups_that_are_only_candidates_fall_apart(spark):
    """A passage of half of each text makes all documents candidates; none is linked."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"w{k}_{i}" for i in range(40))) for k in range(60)]
    assert all(c == d and kept for d, (_, c, kept) in found(spark, rows).items())


def test_one_row_a_key_and_batch(spark, monkeypatch):
    """Thousands of near copies send one row for each key and batch on."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    rows = [(k, len(base), bytes(np.sort(np.append(base[1:], np.uint64(k))).tobytes())) for k in range(1500)]
    sets = spark.createDataFrame(rows, "rid long, n long, tokens binary").coalesce(1)
    out = minhash.banded(sets, 85, 256).where("key IS NOT NULL").groupBy("key").count()
    assert out.where("count > 1").count() == 0


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "x " * 40_000), (8, "x " * 39_999), (None, "a b c d"), (9, "a b c d")]
    got = found(spark, rows)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True)
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False) and got[9] == (2, 9, True) and got[None] == (2, 9, False)
    assert found(spark, []) == {}
