"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a Python stack per expression costs a quarter of the planning time.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def local_session(cpus: str = "8", app: str = "inkwarden", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus),
             "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")}
    for key, value in (SETTINGS | local | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names for checkpoints.

    On a cluster that setting must be there, for executors do not share local folders; a session on one machine
    gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{shared.rstrip('/')}/inkwarden-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """A frame that is read several times, written below the shared folder and read again: its lineage ends there."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to all workers of a cluster on which it is not installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "inkwarden.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("inkwarden", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
