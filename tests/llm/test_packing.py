from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexilink.llm.packing import CAPACITIES, OVERHEAD, cost, open_capacity, pack, pack_documents, pack_jointly, pack_lengths, pack_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def brute(lengths, capacities, overhead):
    """The rule word for word, with a search over all bins."""
    bins, out = [], []
    for k, length in enumerate(lengths):
        fit = [(b["size"] - b["used"], -b["since"], i) for i, b in enumerate(bins) if b["size"] - b["used"] >= length]
        if fit:
            i = min(fit)[2]
        else:
            room = sum(b["size"] - b["used"] for b in bins)
            bins.append({"size": open_capacity(length, sum(lengths[k + 1 :]), room, capacities, overhead), "used": 0, "since": 0})
            i = len(bins) - 1
        out.append((i, bins[i]["used"]))
        bins[i]["used"] += length
        bins[i]["since"] = k + 1
    return out, [min(c for c in capacities if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    capacities = [(8, 16, 32), (10,), (7, 9, 64)][seed % 3]
    lengths = sorted(rng.integers(1, max(capacities) + 1, 200).tolist(), reverse=True)
    bins, offsets, sizes = pack(lengths, capacities, 2)
    want, want_sizes = brute(lengths, capacities, 2)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want and sizes.tolist() == want_sizes


def test_whole_documents_and_capacities(spark):
    rows = [(i, f"{'w ' * int(n)}") for i, n in enumerate(np.random.default_rng(1).integers(0, 3000, 300))]
    rows += [(1000, None), (1001, ""), (None, "x y"), (1002, "w " * 20000), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, capacity long")
    got = pack_documents(df, PATH, group_items=100).toPandas()
    assert got.n_tokens.sum() == sum(len(ids(t)) for _, t in rows)
    for _, one in got.groupby("bin_id"):
        one = one.sort_values("offset")
        assert one.capacity.nunique() == 1 and one.offset.tolist() == np.concatenate([[0], np.cumsum(one.n_tokens)[:-1]]).tolist()
        assert one.capacity.iloc[0] == min(c for c in CAPACITIES if c >= one.n_tokens.sum())
    long = got[got.doc_id == 1002].sort_values("start")
    assert long.start.tolist() == list(range(0, 20001, max(CAPACITIES))) and long.n_tokens.sum() == 20001
    assert got.n_tokens.sum() / got.groupby("bin_id").capacity.first().sum() > 0.9


def test_empty_table_and_single_capacity(spark):
    df = spark.createDataFrame([(0, 1, 0, 5), (1, 2, 0, 4), (2, 3, 0, 3)], "row long, id long, mark long, length long")
    assert pack_lengths(df.limit(0)).count() == 0
    got = {r.id: (r.bin_id, r.offset, r.capacity) for r in pack_lengths(df, (8,), OVERHEAD).collect()}
    assert got == {1: (0, 0, 8), 2: (1, 0, 8), 3: (0, 5, 8)}


@pytest.mark.parametrize("seed", range(6))
def test_joint_choice_is_the_least_of_all(seed):
    rng = np.random.default_rng(seed)
    capacities, overhead = (8, 16, 32), 3
    lengths = sorted(rng.integers(1, [8, 16, 33][seed % 3], 60).tolist(), reverse=True)
    costs = []
    for k in (1, 2, 3):
        for chosen in combinations(capacities, k):
            if max(chosen) >= lengths[0]:
                where = brute(lengths, chosen, overhead)[0]
                used = {}
                for (b, _), n in zip(where, lengths, strict=True):
                    used[b] = used.get(b, 0) + n
                costs.append(sum(min(c for c in capacities if c >= u) + overhead for u in used.values()))
    bins, offsets, sizes = pack_jointly(lengths, capacities, overhead)
    assert cost(sizes, overhead) == min(costs)
    for b in range(len(sizes)):
        mine = np.flatnonzero(bins == b)
        assert sum(lengths[i] for i in mine) <= sizes[b] and sorted(offsets[mine])[0] == 0


def test_equal_rows_fall_in_all_groups(spark):
    items = spark.range(0, 20000, 1, 5).selectExpr("monotonically_increasing_id() AS row", "7L AS id", "1L AS mark", "3L AS length")
    groups = pack_lengths(items, group_items=1000).selectExpr("shiftright(bin_id, 32) AS g").groupBy("g").count().collect()
    assert len(groups) == 20 and max(g["count"] for g in groups) < 1100


def test_sequences_hold_the_ids_of_their_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 50, " ".join(f"word{k}" for k in rng.integers(0, 99, int(rng.integers(0, 60))))) for i in range(80)] + [(None, None), (99, "long " * 300)]
    got = pack_sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, capacities=(32, 64, 128), overhead=4).collect()
    pieces = []
    for r in got:
        held = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(held) == sum(p.n_tokens for p in r.pieces) <= r.capacity and r.capacity == min(c for c in (32, 64, 128) if c >= len(held))
        pieces += [(p.id, p.start, held[p.offset : p.offset + p.n_tokens]) for p in r.pieces]
    want = [(doc, at, ids(text)[at : at + 128]) for doc, text in rows for at in range(0, len(ids(text)), 128)]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)


def test_placements_are_a_function_of_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 700), f"{'w ' * int(rng.integers(0, 90))}") for i in range(1000)] + [(3, "same " * 9)] * 40 + [(None, None)] * 5
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = pack_documents(df, PATH, group_items=150, capacities=(64, 128), overhead=4)
        assert got.columns == ["bin_id", "capacity", "doc_id", "mark", "copy", "start", "n_tokens", "offset", "ids"]
        found.append(sorted(map(repr, got.collect())))
    assert found[0] == found[1]


def test_pieces_carry_their_ids(spark):
    rows = [(1, "one two three " * 100), (2, None), (3, "x")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacities=(64,), overhead=1).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        held = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(held) == r.n_tokens
        whole.setdefault(r.doc_id, []).extend(held)
    assert whole == {d: ids(t) for d, t in rows}
