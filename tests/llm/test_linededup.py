import hashlib

import pytest

from lexilink.llm.common import Scratch
from lexilink.llm.linededup import LineRuns, dedup_lines

LONG = "This line is long enough"
ROWS = [
    (1, f"{LONG}\na\n{LONG}"), (2, f"  {LONG.upper()}\t\r\nb"), (3, f"c\n{LONG} \x0b"), (4, f"{LONG}.\nshort"), (5, None), (6, ""), (7, "\n"), (8, "short"), (9, "short"),
    (10, "short"), (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, "é" * 20), (15, "É" * 20), (16, "é" * 20), (17, "é" * 20 + "\nz"), (18, f" {LONG}"),
    (19, "\n".join(f"line number {i} which is repeated" for i in range(2000))), (20, "\n".join(f"line number {i} which is repeated" for i in range(2000))), (21, "\n".join(f"line number {i} which is repeated" for i in range(1000))),
]


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch_lines", [10**9, 900, 500])
def test_equals_brute_force(spark, batch_lines):
    df = spark.createDataFrame([(d, t, "h1", 3) for d, t in ROWS], "doc_id long, text string, h1 string, pos int").repartition(4)
    got = {r.doc_id: (r.llm_n_lines, r.llm_n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in dedup_lines(df, batch_lines=batch_lines).collect()}
    assert got == brute(ROWS)


def test_null_text_stays_and_columns_stay(spark):
    df = spark.createDataFrame([(1, None, "x")], "doc_id long, text string, drops string")
    assert [tuple(r) for r in dedup_lines(df).collect()] == [(1, None, "x", 1, 0)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG + "\nx"), (2, LONG), (None, LONG), (None, LONG)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, ""), (1, "x"), (2, LONG), (None, ""), (None, "")], key=repr)


def test_runs_are_levelled_and_merged(spark):
    runs = LineRuns(Scratch(spark), buckets=2, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(i, i, 100 - k) for i in range(k, k + 3)], "h1 long, h2 long, doc long")
        fresh = {r.h1 for r in runs.add(batch).collect()}
        assert fresh == ({0, 1, 2} if k == 0 else {k + 2})
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1: r.n_docs for r in runs.totals().collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1}
    runs.drop()


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, LONG, i, "a", "b", 7, 8) for i in range(4)], "doc_id long, text string, __doc long, _doc string, _DROPS string, llm_n_lines int, _mark int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "__doc", "_doc", "_DROPS", "_mark", "llm_n_lines", "llm_n_dropped"]
    assert {r.doc_id: (r.text, r._doc, r.llm_n_lines, r.llm_n_dropped) for r in got.collect()} == {i: (LONG if i == 3 else "", "a", 1, int(i < 3)) for i in range(4)}
    kept = dedup_lines(df, with_counts=False, broadcast_keys=0)
    assert kept.columns == df.columns and {r.doc_id: (r.text, r.llm_n_lines) for r in kept.collect()} == {i: (LONG if i == 3 else "", 7) for i in range(4)}


def test_levels_occur_at_any_size_and_runs_go_when_a_job_fails(spark, monkeypatch):
    from lexilink.llm import linededup

    depths = []
    plain = LineRuns._compact
    monkeypatch.setattr(LineRuns, "_compact", lambda self: (plain(self), depths.append(len(self.levels)))[0])
    df = spark.createDataFrame([(i, f"{LONG} {i % 40}") for i in range(200)], "doc_id long, text string")
    dedup_lines(df).collect()
    assert max(depths) >= 3  # two levels above that of the batches
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(LineRuns, "totals", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        linededup.dedup_lines(df)
    assert {t.name for t in spark.catalog.listTables()} == before
