import duckdb
import pytest

import __spark_entry__ as E
from corpusloom import queries as core


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = E.queries()[name](spark, small)
    want = con.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert rows(got) == sorted(map(repr, want.project(cols).fetchall()))


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
