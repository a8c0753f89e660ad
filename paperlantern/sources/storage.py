"""Helpers on the Hadoop file system API."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _at(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already.

    Of several that try at once one succeeds, as far as the file system's own create without
    overwriting is atomic, which it is on HDFS."""
    jvm_path, fs = _at(spark, path)
    fs.mkdirs(jvm_path.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's own create looks first and creates then
        return spark._jvm.java.io.File(jvm_path.toUri().getPath()).createNewFile()
    try:
        return fs.createNewFile(jvm_path)
    except Py4JJavaError:
        if fs.exists(jvm_path):  # another one came first, between the look and the create
            return False
        raise


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of the last change in ms) of what a folder holds; nothing if there is no such folder."""
    jvm_path, fs = _at(spark, path)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []


def remove(spark: SparkSession, path: str) -> None:
    jvm_path, fs = _at(spark, path)
    fs.delete(jvm_path, True)
