"""The parquet tables that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ship_package


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` if given, so that the scan reads no others."""
    ship_package(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream_table(spark: SparkSession, folder: str, name: str, files_at_once: int = 4) -> DataFrame:
    """Table ``name`` of ``folder`` as a stream of its files, whether it is one file or a folder of them."""
    place = f"{folder}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()  # noqa: SLF001
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_at_once)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(place)
