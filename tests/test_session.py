from __future__ import annotations

import glob
import subprocess
import sys

from plumbline.session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir
from plumbline.sources.tables import stream_table, table

from tests.conftest import ROOT


def test_broadcast_only_below_the_bound(spark):
    small, large = (spark.range(n).withColumnRenamed("id", "k") for n in (5, 500))
    plan = lambda df: spark.range(9).withColumnRenamed("id", "k").join(df, "k")._jdf.queryExecution().optimizedPlan().toString()  # noqa: E731, SLF001
    assert "broadcast" in plan(broadcast_if_small(small, "k", 10)) and "broadcast" not in plan(broadcast_if_small(large, "k", 10))


def test_lineage_is_cut_in_the_checkpoint_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == ensure_checkpoint_dir(spark)
    df = cut_lineage(spark.range(7).selectExpr("id * 2 AS x"))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 7  # noqa: SLF001


def test_the_named_folder_is_used(tmp_path):
    """A session of its own: code and checkpoints go to the folder of ``spark.checkpoint.dir``; workers find the package."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from plumbline.session import cut_lineage, ship_package
from plumbline.functions.text import comparable_column
ship_package(spark); ship_package(spark)
print("rows", cut_lineage(spark.range(3).select(comparable_column(F.lit("A")).alias("x"))).count())
import glob
print("files", len(glob.glob("{tmp_path}/shared/plumbline-code-*/plumbline.zip")), len(glob.glob("{tmp_path}/shared/*")))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "rows 3" in done.stdout, done.stderr[-2000:]
    assert "files 1 2" in done.stdout, done.stdout
    assert not glob.glob(f"{tmp_path}/shared/plumbline-*")  # removed when the driver ended


def test_tables(spark, folder):
    assert table(spark, folder, "documents", "doc_id").columns == ["doc_id"]
    assert stream_table(spark, folder, "captures").isStreaming


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from plumbline.session import broadcast_if_small, written

    small = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "k int, v string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()  # noqa: E731, SLF001
    assert hinted(broadcast_if_small(small, "k")) and not hinted(broadcast_if_small(small, "k", max_rows=19)) and not hinted(broadcast_if_small(small, "k", max_bytes=2000))
    left = spark.range(40).selectExpr("cast(id AS int) AS k")
    rows = [left.join(broadcast_if_small(small, "k", max_bytes=b), "k").count() for b in (0, 10**6)]
    assert rows == [20, 20] and broadcast_if_small(small.limit(0), "k").count() == 0
    again = written(small)
    assert again.schema == small.schema and again.count() == 20 and written(small.limit(0)).count() == 0
