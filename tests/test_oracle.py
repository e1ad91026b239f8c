"""Every registered query with an oracle gives DuckDB's rows; the rest run."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from feedloom.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([round(r[k], 4) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == plain(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
