"""Each registered query against its SQL; the entry module with and without the optional parts."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        out.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return out


def rows(values):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name not in catalogue.ORACLE_SQL:
        assert df.count() > 0
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = rows(df.select(*columns).collect())
    assert got == rows(want.select(*columns).fetchall()) and got


@pytest.mark.parametrize("name", ["asof_lerp", "asof_lerp_clamp"])
def test_lerp_of_units_that_are_cut(spark, con, monkeypatch, name):
    """Five units of 1,460 targets each in ranges of about 300 rows: the rows of the SQL, and no task has a whole unit."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 300)
    out = catalogue.QUERIES[name](spark, DATA).withColumn("task", F.spark_partition_id()).collect()
    assert rows(r[:3] for r in out) == rows(con.sql(catalogue.ORACLE_SQL[name]).select("unit", "t_idx", "value").fetchall())
    tasks = [r["task"] for r in out]
    assert len(set(tasks)) > 10 and max(tasks.count(k) for k in set(tasks)) < 730


@pytest.mark.parametrize("name", ["gradient", "speed"])
def test_slopes_of_events_at_one_time(spark, tmp_path, name):
    """Four events a time, in a file in no order: the rows of the SQL where its order of time goes on with the event's number."""
    con = duckdb.connect()
    con.sql("create table events as select i as event_id, timestamp '2024-01-01' + to_seconds(i // 8) as ts, i % 2 as user_id, 'kind ' || i % 2 as event_type, (i * 7 % 11)::double as value from range(800) r(i)")
    con.sql(f"copy (from events order by hash(event_id)) to '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name].replace("ORDER BY t)", "ORDER BY t, event_id)"))
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_users_are_told_apart(spark, tmp_path):
    """Users 0 and 6, who act at different places in turn, six hours each: the decoder finds the place from who acts, as the SQL does."""
    con = duckdb.connect()
    con.sql("create table events as select i as event_id, timestamp '2024-01-01' + to_minutes(18 * i) as ts, 6 * (i // 20 % 2) as user_id, 'view' as event_type, 75.0 + 350 * (i // 20 % 2) as value from range(400) r(i)")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    got = catalogue.QUERIES["decode_sessions"](spark, str(tmp_path)).toPandas()
    want = con.sql(catalogue.ORACLE_SQL["decode_sessions"])
    assert rows(got[want.columns].values.tolist()) == rows(want.fetchall())
    low = got[got.bin < 5].groupby("t_idx").acausal.sum()
    assert all(abs(low[t] - (t % 2 == 0)) < 0.01 for t in range(20))


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
