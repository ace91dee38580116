import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(entry.catalog.ORACLES)))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns

    def row(values, names):
        return tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for _, v in sorted(zip(names, values)))

    assert sorted(row(r, got.columns) for r in got.collect()) == sorted(row(r, names) for r in want.fetchall())
