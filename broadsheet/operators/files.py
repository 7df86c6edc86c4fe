"""Small control files beside tables, on whatever file system the tables are on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published files of a folder, none where there is no folder; unfinished ones begin with _ or a dot."""
    system, target = _at(spark, folder)
    if not system.exists(target):
        return []
    found = (status.getPath().getName() for status in system.listStatus(target))
    return sorted(n for n in found if n[0] not in "_.")


def read(spark: SparkSession, path: str) -> str:
    system, target = _at(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that appears whole or not at all; False if another one is there already."""
    system, target = _at(spark, path)
    if system.exists(target):
        return False
    staged = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(staged, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return bool(system.rename(staged, target))
