"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from blockfold.oracle import ORACLE_SQL
from blockfold.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.exists(DATA):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{DATA}/events.parquet'")
    return c


def test_every_query_but_signatures_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"signature_text"}
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert len(mine) > 300
        return
    found = db.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    theirs = sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("event_type", ["click", "view"])
def test_report_with_and_without_findings(spark, tmp_path, event_type):
    own = duckdb.connect()
    own.sql(f"""create table events as select i as event_id, make_timestamp(1704067200000000 + i // 8 * 1800000000) as ts, i % 3 as user_id,
      '{event_type}' as event_type, 1.5 as value, '{{"k": 3}}' as props from range(80) t(i)""")
    own.sql(f"copy events to '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in QUERIES["v_report"](spark, str(tmp_path)).select("n", "errors", "status").collect()]
    assert got == own.sql(ORACLE_SQL["v_report"]).select("n", "errors", "status").fetchall() == [(0, 0, "passed") if event_type == "click" else (9, 9, "failed")]
