"""Every registered query runs on the smallest tables and, where it has SQL, gives the same rows."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

D = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not D.exists(), reason="needs the test tables")
SQL = entry.oracle_sql()
CORE = sorted(set(entry.queries()) - set(entry._llm_queries.QUERIES if entry._llm_queries else {}))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in D.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(D))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name in SQL:
        want = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()), key=repr)
        assert got == want


def test_entry_and_oracles_are_registered(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
