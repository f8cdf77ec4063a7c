"""Queries of the subpackage equal their SQL twins."""

from __future__ import annotations

import os

import duckdb
import pytest

from placeprint.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    queries.queries()[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    columns = sorted(c[0] for c in con.execute("DESCRIBE got").fetchall())
    assert columns == sorted(c[0] for c in con.execute("DESCRIBE want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []
