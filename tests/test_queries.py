"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import decimal

import duckdb
import pytest

from papyra.queries import ORACLE_SQL, ORDER, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for name in ORDER:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return out


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if v != v else round(float(v), 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        return
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
