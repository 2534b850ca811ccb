"""Writers for result tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_workbook(tables: Mapping[str, DataFrame], path: str) -> None:
    """A named set of tables, one folder each."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def write_per_key(df: DataFrame, path: str, *keys: str, rows_per_file: int = 5_000_000) -> None:
    """One folder per project, client or other key.

    Rows are rebalanced by key before the write: small keys share a task and a few
    files, a hot key is split over several tasks by adaptive execution.
    """
    balanced = df.hint("rebalance", *[F.col(k) for k in keys])
    balanced.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path)


def write_snapshot(df: DataFrame, path: str, as_of: dt.date) -> None:
    """A dated copy below ``path``; other days stay untouched."""
    dated = df.withColumn("snapshot_date", F.lit(as_of))
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )
