"""Every registered query of the core on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from plumbline.plans import coverage, scans  # noqa: F401 - they register queries
from plumbline.plans.queries import ORACLE, QUERIES


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (float, Decimal)):
        return None if value != value else round(float(value), 6)
    if isinstance(value, pd.Timestamp):
        return str(value)
    return value.item() if hasattr(value, "item") else str(value) if isinstance(value, (list, dict, tuple)) else value


def bag(frame: pd.DataFrame) -> Counter:
    return Counter(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert bag(got) == bag(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tbl", "k1", "k2", "snapshot_no", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
