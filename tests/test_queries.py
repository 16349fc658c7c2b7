"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(table):
    return sorted(repr([plain(r[k]) for k in sorted(r)]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, other = entry.queries()[name](spark, SF).toArrow(), con.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(mine.schema.names) == sorted(other.schema.names)
    assert rows(mine) == rows(other)


def test_entry(spark):
    assert entry.entry(spark).count() == 64 * 63
