"""Registered queries against their SQL, and the entry module without the corpus operators."""

from __future__ import annotations

import datetime
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") and not isinstance(v, str | bytes) else v
    if isinstance(v, list):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, datetime.date):
        return str(v)[:10]
    return float(v) if isinstance(v, int | float) else v


def rows(pdf):
    return sorted(repr([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SMALL).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def copied_events(spark, path, copies, key):
    """The events several times, their ids made by ``key`` from event_id and i."""
    made = spark.read.parquet(f"{SMALL}/events.parquet").crossJoin(spark.range(copies).withColumnRenamed("id", "i"))
    made.selectExpr(f"{key} AS event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("key", ["event_id * 4 + i", "event_id + 100000 * i", "event_id"])
def test_daily_rollup_counts_events_that_say_the_same(spark, tmp_path, key):
    con = copied_events(spark, tmp_path, 4, key)
    assert rows(entry.queries()["daily_rollup"](spark, str(tmp_path)).toPandas()) == rows(con.sql(entry.oracle_sql()["daily_rollup"]).df())


@pytest.mark.parametrize("key", ["event_id * 4 + i", "event_id"])
@pytest.mark.parametrize("name", ["last_days", "zero_streak"])
def test_days_count_events_that_say_the_same(spark, tmp_path, name, key):
    con = copied_events(spark, tmp_path, 4, key)
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/noticeworks", tmp_path / "noticeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
