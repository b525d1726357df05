"""The registered queries against their SQL on the driver's tables."""

from __future__ import annotations

import duckdb
import pytest

from massloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, data_dir, name):
    with duckdb.connect() as con:
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
        want = con.execute(queries.oracle_sql()[name])
        columns, rows = [d[0] for d in want.description], want.fetchall()
    got = queries.queries()[name](spark, data_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_per_document(spark, data_dir, name):
    out = queries.queries()[name](spark, data_dir)
    n = spark.read.parquet(f"{data_dir}/documents.parquet").count()
    assert out.select("doc_id").distinct().count() == n and (out.count() == n or name.startswith("op5"))
