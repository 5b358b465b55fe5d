"""Queries with SQL give the SQL's rows."""

import os

import duckdb
import pytest

from thermofleet.llm.queries import QUERIES, SQL
from tools.check_oracle import rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
