"""The registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from lexilink.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got, want = queries.queries()[name](spark, DIR).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  pandas holds whole numbers beside nulls as floats
    as_rows = lambda d: sorted(repr(tuple(map(whole, r))) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
