"""Every registered query that has SQL, against DuckDB on the same files."""

import datetime
import math
import os

import pytest

import wideframe.registry as registry

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return repr(list(v)) if isinstance(v, (list, tuple)) else repr(v)

    return sorted(columns), sorted([plain(r[k]) for k in order] for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(registry.oracle_sql()[name])
    assert mine == rows([d[0] for d in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
