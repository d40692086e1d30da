"""Folders of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _at(spark, folder)
    return system.exists(path)


def entries(spark: SparkSession, folder: str) -> list[str]:
    """Full names of what lies in a folder, sorted; none if it does not exist."""
    system, path = _at(spark, folder)
    return sorted(str(found.getPath().toString()) for found in system.listStatus(path)) if system.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _at(spark, folder)
    system.delete(path, True)
