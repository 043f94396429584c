"""Every registered query against its DuckDB oracle (small scale factor)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    """Comparable, type-tagged form (None sorts with everything)."""
    if v is None:
        return ("n", "")
    if isinstance(v, bool):
        return ("o", str(v))
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, int):
        return ("i", f"{v:+025d}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return ("b", bytes(v).hex())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "cluster_cpu" in df.columns


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns  # runs; what it returns is held by tests of its own
        return
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    cols = sorted(ocols)
    mine = sorted(tuple(_norm(r[c]) for c in cols) for r in rows)
    idx = [ocols.index(c) for c in cols]
    theirs = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert mine == theirs
