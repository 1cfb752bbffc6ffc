"""Every query of the core that has SQL gives what the SQL gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from threadstone.plans import catalogue, problems, stored

DATA = Path("/root/testdata/sf0.001")
QUERIES = {**problems.QUERIES, **catalogue.QUERIES, **stored.QUERIES}
SQL = {**problems.SQL, **catalogue.SQL, **stored.SQL}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(SQL[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    df.write.format("noop").mode("overwrite").save()
    assert len(df.columns) > 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
