"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_STAMPS = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_STAMPS).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
    fmt: str = "parquet",
) -> None:
    """Write a table. Overwriting replaces only the partitions present in ``df``
    (partitionOverwriteMode=dynamic)."""
    writer = df.write.mode(mode).format(fmt)
    writer = writer.option("partitionOverwriteMode", "dynamic") if partition_by else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_jdbc(df: DataFrame, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("dbtable", table).options(**options).mode(mode).save()


def write_chain(
    chain: DataFrame, path: str, by: Sequence[str] = ("expiry", "ce_or_pe")
) -> None:
    """Chain snapshot by expiry and side, strikes in order inside a file.

    Range partitioning keeps a partition's rows in few files and still splits an expiry
    that holds most of the rows.
    """
    order = [*by, "strike", "token"]
    write_table(chain.repartitionByRange(*order).sortWithinPartitions(*order), path, by)


def write_config(config: DataFrame, root: str) -> None:
    """Config records, filed once by future expiry and once as the current ones."""
    by_expiry = config.withColumn("filed_under", F.col("FUT_EXPIRY_DATE_STR"))
    by_expiry.write.mode("overwrite").options(
        **_STAMPS, partitionOverwriteMode="dynamic"
    ).partitionBy("filed_under").json(
        f"{root}/by_expiry"
    )
    write_json(config, f"{root}/current")


def append_rows(
    df: DataFrame, path: str, computed: Mapping[str, Column] | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Append rows; ``computed`` columns are filled by expressions at write time, e.g.
    ``{"CRE_DATIME": F.current_timestamp()}``."""
    write_table(df.withColumns(dict(computed or {})), path, partition_by, mode="append")
