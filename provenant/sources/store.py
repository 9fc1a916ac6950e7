"""Small text files beside the data: the Hadoop file system of a path is asked, so any shared store serves."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(path: str):
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(path: str) -> str | None:
    """The whole file in UTF-8, or None where there is none."""
    spark, where, fs = _open(path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replaces the file; folders above it are made."""
    _, where, fs = _open(path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
