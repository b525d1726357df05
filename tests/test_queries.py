"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from massloom.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(tuple("nan" if isinstance(r[k], float) and math.isnan(r[k]) else repr(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data_dir, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
        want = con.execute(SQL[name])
        columns, rows = [d[0] for d in want.description], want.fetchall()
    got = QUERIES[name](spark, data_dir)
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0
