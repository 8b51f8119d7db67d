"""Every registered query with SQL gives the rows of DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from biblio_spark.plans import registry

registry.load()
DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "none"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
