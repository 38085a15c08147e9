"""How folders are named: for Spark's readers and for tasks that open files themselves."""

from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's whole URI, spelled as listings spell it; a folder without a
    scheme lies on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString()


def store_uri(spark: SparkSession, folder: str) -> str:
    """The same folder as tasks open it: ``s3`` for ``s3a``, ``file:///`` for ``file:/``."""
    scheme, rest = qualified(spark, folder).split(":", 1)
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest
