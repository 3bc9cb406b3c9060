"""Session set-up, the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, ANSI, AQE)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    ``spark.checkpoint.dir`` names the folder that all executors share and is used when set. Only where it is unset
    (tests on one machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation of its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, removed when the driver ends in good order."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove_folders)
    _FOLDERS.append((spark, place))
    return place


_FOLDERS: list[tuple[SparkSession, str]] = []


def _remove_folders() -> None:
    for spark, place in _FOLDERS:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
        except Exception:  # noqa: BLE001, S110 - the session is gone already, and the folder stays
            pass


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: like :func:`cut_lineage`, but later reads take only the columns they need."""
    place = shared_folder(df.sparkSession, "table")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Bytes up to which a table may be sent to every executor.
BROADCAST_BYTES = 32_000_000


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory, by the actual lengths of its texts and arrays."""
    total = F.lit(16)
    for field in df.schema:
        kind = field.dataType.typeName()
        value = F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(value), F.lit(0)) + 8
        elif kind in ("array", "map"):
            total = total + 16 * F.greatest(F.size(value), F.lit(1))
        else:
            total = total + 8
    return total.cast("long")


def broadcast_if_small(df: DataFrame, key: str, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for ``df`` only if it has at most ``max_rows`` rows of at most ``max_bytes`` in all; the plain frame otherwise.

    One job reads ``max_rows + 1`` rows at most and sums their widths, so ``df`` should be a table or a frame whose lineage is cut:
    what is costly to compute would be computed twice. Without the hint Spark shuffles the join, which holds at any size.
    """
    seen = df.select(_width(df).alias("w")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    return F.broadcast(df) if seen.n <= max_rows and seen.w <= max_bytes else df


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once for each Spark application.

    Workers that find the package on their own path use that; others import what Spark delivers. The archive is put into
    the folder that ``spark.checkpoint.dir`` names; only where that is unset into a temporary one.
    """
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    out.write(full, os.path.join("plumbline", os.path.relpath(full, root)))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        place = f"{shared_folder(spark, 'code')}/plumbline.zip"
        target = sc._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001
        stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)  # noqa: SLF001
        stream.write(bytearray(packed.getvalue()))
        stream.close()
    elif not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        place = os.path.join(tempfile.mkdtemp(prefix="plumbline-code-"), "plumbline.zip")
        with open(place, "wb") as out:
            out.write(packed.getvalue())
    sc.addPyFile(place)  # Spark copies it to every executor
    sc._plumbline_shipped = True  # noqa: SLF001
