"""Small files in the file system that Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """File system and path as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, place = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_whole(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that readers see whole or not at all; an existing one is never replaced.

    It is written under another name and renamed, which is one step in the file system.
    """
    fs, place = _at(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{place.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if fs.exists(place) or not fs.rename(hidden, place):
        fs.delete(hidden, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def age_ms(spark: SparkSession, path: str, now_ms: int) -> int:
    fs, place = _at(spark, path)
    return now_ms - fs.getFileStatus(place).getModificationTime()
