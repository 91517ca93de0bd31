"""Folders of the store that Spark writes to."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The folder, and the file system that it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, so that other libraries than Spark take it to the same store."""
    where, store = located(spark, path)
    found = store.makeQualified(where).toString()
    return found.replace("file:/", "file:///", 1) if re.match("file:/[^/]", found) else found


def exists(spark: SparkSession, path: str) -> bool:
    where, store = located(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that it holds; one that is not there is no error."""
    where, store = located(spark, path)
    store.delete(where, True)
