import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    # Rows of these are compared with brute force where their operators are tested; here they must be made, and not be empty.
    assert entry.queries()[name](spark, str(DATA)).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_engine(spark, tmp_path):
    from logweave.api import Engine

    e = Engine(spark, str(DATA))
    assert "tool_mix" in e.names() and e.runs().count() > 0 and e.search("price table").count() <= 12
    assert e.state_at(1772323200000000).columns[-1] == "state"
    assert e.calls(failed_only=True).count() > 0 and e.calls("py read").count() > 0 and e.status().count() > 0
    e.export("tool_mix", "csv", str(tmp_path / "c"))
    e.export("tool_mix", "json", str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() > 0
