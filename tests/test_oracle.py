"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lexilink.plans import catalog

DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


#: Formats of lines: only the larger tables have line breaks and tabs inside words.
LINES = ["concept_files", "document_files", "generative_files", "generative_results", "plain_text_files", "pubtator_files", "pubtator_format", "bioc_json_files"]


def views(d):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return {d: views(d) for d in (DIR, LARGER)}


def whole(v):
    """pandas holds whole numbers beside nulls as floats; sums of floats may differ in their last digits."""
    return (int(v) if v.is_integer() else float(f"{v:.9g}")) if isinstance(v, float) else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(map(whole, r))) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize(("name", "d"), [(n, DIR) for n in sorted(ORACLE)] + [(n, LARGER) for n in LINES])
def test_equals_sql(spark, duck, name, d):
    got, want = QUERIES[name](spark, d).toPandas(), duck[d].sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
