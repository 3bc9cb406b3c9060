"""Every registered query of the subpackage on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import duckdb
import pytest
from plumbline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "eval_items"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        want = con.sql(ORACLE[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        clean = lambda f: sorted(map(tuple, f[cols].astype("float64").round(6).fillna(-1).to_numpy().tolist()))
        assert clean(got) == clean(want)
