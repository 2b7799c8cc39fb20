import random
import re

import pytest

from lexilink.llm.decontaminate import decontaminate, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i : i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, ITEM), (2, "Short item here"), (3, None), (4, "..."), (5, ITEM + " thirteen"), (6, "é ü"), (2, "short ITEM here")]
DOCS = [
    (1, None), (2, ""), (3, "x " + ITEM + " y"), (4, " ".join(ITEM.split()[:9])), (5, ITEM.upper().replace(" ", "-- ")), (6, "a short item here short, item. HERE!"),
    (7, " ".join(ITEM.split()[:10]) + " gap " + " ".join(ITEM.split()[2:])), (8, "é ü É ü"), (9, (ITEM + " ") * 300), (10, "clean text " * 3000), (None, ITEM), (11, ITEM + " thirteen"), (12, "short item"),
]


@pytest.mark.parametrize("most", [1000, 0])
def test_equals_brute_force(spark, most):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, words string, hash int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(docs, items, broadcast_windows=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in got), key=repr) == brute(DOCS, ITEMS)
    assert all(r.n_items == len(r["items"]) for r in got)


def test_items_without_id_hit_and_count_as_one(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (2, "short item here " + ITEM), (3, "clean"), (4, "other item text " + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (7, "short item here"), (None, "other item text")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, set(r["items"]), r.contaminated) for r in decontaminate(docs, items).collect()}
    assert got == {1: (12, 1, {None}, True), 2: (15, 2, {None, 7}, True), 3: (0, 0, set(), False), 4: (15, 1, {None}, True)}
    assert [r.doc_id for r in remove_contaminated(docs, items).collect()] == [3]


def test_items_without_id_equal_sql(spark, tmp_path):
    import duckdb

    from lexilink.llm import queries

    spark.createDataFrame([(1, "x " + ITEM), (2, "short item here " + ITEM), (3, "clean")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, ITEM), (7, "short item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op3_benchmark_decontamination(spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(queries.OP3_SQL).fetchall())


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, f"A b, {ITEM} C.", 7), (2, "clean", 7), (3, ITEM, 7), (4, None, 7)], "doc_id long, text string, __x int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in remove_contaminated(docs, items).collect()} == {2, 4}
    cut = {r.doc_id: r.text for r in remove_contaminated(docs, items, max_share=0.9).collect()}
    assert cut == {1: "A b C.", 2: "clean", 4: None}


def test_removal_tells_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (1, "clean"), (None, ITEM), (None, "clean too"), (None, None), (1, "x " + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = sorted(map(tuple, remove_contaminated(docs, items).collect()), key=repr)
    assert got == sorted([(1, "clean"), (None, "clean too"), (None, None)], key=repr)
    cut = sorted(map(tuple, remove_contaminated(docs, items, max_share=0.95).collect()), key=repr)
    assert cut == sorted([(1, "x"), (1, "x"), (1, "clean"), (None, "clean too"), (None, None)], key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate(docs.limit(0), items).count() == 0
    assert not decontaminate(docs, items.limit(0)).first().contaminated


def test_random_windows_equal_brute_force(spark):
    """Items of all lengths, cut from documents at every offset, over few different words."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 120)))) for i in range(120)]
    items = []
    for k in range(60):
        w = rng.choice(docs)[1].split()
        at = rng.randrange(0, len(w) + 1)
        items.append((k, " ".join(w[at : at + rng.randrange(1, 16)])))
    items = [x for x in items if len(x[1].split()) > 5 or x[0] % 9 == 0]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in got), key=repr) == brute(docs, items)


def test_clashing_names(spark):
    names = ["__share", "_share", "_doc", "_MARK", "mark", "doc", "around", "a", "items", "n_words"]
    docs = spark.createDataFrame([(1, ITEM, *names), (2, "clean", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for share in (0.0, 0.5):
        got = remove_contaminated(docs, items, max_share=share)
        assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "clean", *names)]
    assert {r.doc_id: r.contaminated for r in decontaminate(docs, items).collect()} == {1: True, 2: False}
