"""Small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import strikeline

_shipped: set[str] = set()
#: Arrow batches are cut at this size, so that rows with long texts do not fill a task's memory.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """What every operator with Python workers calls first: hands this package to Spark, which
    copies it to the executors, so that workers can import it wherever the driver was started
    (once for each application), and bounds the size of the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(strikeline.__file__).parent
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(
            f"{folder}/{package.name}", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed.

    ``lower`` does just that for pure ASCII and is much faster than ``translate``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rows up to which a stored table of a few numbers a row is broadcast (some 10 MB at most).
SMALL_ROWS = 100_000


def if_small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it is counted to be small; else it is joined by a
    shuffle. The table should be stored, so that counting costs nothing."""
    return F.broadcast(table) if table.count() <= rows else table


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, ``size`` rows of it), in
    which no group gathers in a task.

    Groups with more than a quarter of a partition's share of ``total`` rows, at most four
    per partition, are broadcast; the others are joined by a shuffle.
    """
    many = F.col(size) > max(1, total // (4 * partitions_of(rows.sparkSession)))
    large = groups.where(many)
    tried = rows.join(F.broadcast(large), key, "left")
    by_shuffle = (
        tried.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~many), key)
    )
    return tried.where(F.col(size).isNotNull()).unionByName(by_shuffle)
