"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "broadsheet", master: str | None = None) -> SparkSession:
    """A UTC session with adaptive execution and skew handling switched on.

    On a cluster the master, memory and shuffle width come from spark-submit;
    only local runs pass ``master``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot key even where that costs a second shuffle further on.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        cores = master.removeprefix("local[").removesuffix("]")
        width = cores if cores.isdigit() else str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", width)
        )
    session = builder.getOrCreate()
    ship_package(session)
    return session


_shipped: set[str] = set()

#: Rows of an Arrow batch: bounds what a Python worker holds at a time where rows carry whole texts.
BATCH_ROWS = 2_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started.

    Lowers the size of Arrow batches where the session has Spark's own default.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="broadsheet-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a scratch one only in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="broadsheet-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that later steps never recompute it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all shuffle partitions, for steps whose cost is work per row, not bytes.

    The explicit number keeps adaptive execution from merging small partitions
    back into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def widen(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than there are cores.

    Meant in front of costly per-row work on few or unsplittable files. A large
    input has more splits than cores and is returned as it is, without shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
