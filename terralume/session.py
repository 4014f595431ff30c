"""Session settings shared by jobs, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plan shape; sizes stay with the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Generated methods above 8000 bytes are never compiled by HotSpot; geometry
    # expressions reach that size and run faster outside one fused method then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int = 8, name: str = "terralume") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("TERRALUME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local master without the setting gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder is
    lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="terralume-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores, by keys if any, before work that is long for each row.

    A table of short rows is a small file, which few tasks read; the number is given because AQE
    would join partitions of so few bytes again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read to the shared folder and read it back.

    Survives lost executors, and the file sizes give the planner statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
