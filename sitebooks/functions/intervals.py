"""Days that fall into windows given as a table, without a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket: windows of about this length meet about two buckets each.
BUCKET_DAYS = 31


def in_windows(
    rows: DataFrame, day: str, windows: DataFrame, first: str, last: str, bucket_days: int = BUCKET_DAYS
) -> DataFrame:
    """Each row once per window that holds its day, ends included, with the window's columns.

    Windows may overlap, repeat and have any length.  Each is repeated for the buckets of days it touches, a row
    lies in one bucket, so bucket numbers make an equi join and the exact ends a filter behind it.  Unknown
    days and ends, and windows that end before they start, hold nothing.  Names must not clash.
    """
    clash = set(rows.columns) & set(windows.columns)
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")

    def bucket(column: str) -> Column:
        return F.floor(F.unix_date(column) / bucket_days)

    touched = windows.where(F.col(first) <= F.col(last)).withColumn(
        "__bucket", F.explode(F.sequence(bucket(first), bucket(last)))
    )
    placed = rows.withColumn("__bucket", bucket(day))
    return placed.join(touched, "__bucket").where(F.col(day).between(F.col(first), F.col(last))).drop("__bucket")
