"""Every query with SQL gives the same rows in another engine; the library works without the corpus operators."""

import math
import subprocess
import sys

import duckdb
import pytest

from quotewright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def other(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v)
    return sorted(([fix(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, sf, other):
    want = other.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_imports_without_corpus_operators():
    code = "import sys; sys.modules['quotewright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bbo' in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
