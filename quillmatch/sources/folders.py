"""Existence and removal of folders in whatever store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _in_store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _in_store(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it, if it exists."""
    store, place = _in_store(spark, path)
    store.delete(place, True)
