"""Dated extracts that are compared as bags of rows.

An extract is stored in parts (months, say).  Next to its rows stand their counted digests and one line
per part: how many rows it has and a checksum over its digests.  Two extracts are compared from the small
end: parts with equal lines are not read, digests of the other parts meet in one join, and only rows
whose number of copies changed are fetched.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import in_changed_parts

ROWS, DIGESTS, PARTS, SHAPE = "rows", "digests", "parts", "shape"
_DAY, _PART = "snapshot_date", "snapshot_part"


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's columns, unknown values told apart from empty ones."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _checksum(start: int) -> Column:
    """Sixty bits of each digest, times its copies, summed up without overflow."""
    bits = F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(20,0)")
    return F.sum(bits * F.col("copies")).cast("decimal(38,0)")


def write_counted_snapshot(df: DataFrame, path: str, as_of: dt.date, part: Column) -> None:
    """Store the rows of a day in parts, their counted digests, and a line per part.

    ``part`` is a text by which rows stay together from one extract to the next; unknown is a part of its own.
    Writing a day again replaces it; other days stay untouched.
    """
    spark = df.sparkSession
    # the prefix keeps part names texts, also where they look like numbers, days or nothing
    named = F.when(part.isNull(), "part").otherwise(F.concat(F.lit("part:"), part))
    rows = df.select("*", row_digest(df.columns).alias("digest"), named.alias(_PART))

    def store(table: DataFrame, name: str, *keys: str) -> None:
        table.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}/{_DAY}={as_of.isoformat()}")

    # an extract without rows has no parts to read its columns from
    store(rows.where("false").coalesce(1), SHAPE)
    # one folder per part: rows are brought together by part, a hot part is split over several tasks
    store(rows.hint("rebalance", F.col(_PART)), ROWS, _PART)
    counted = _day(spark, path, ROWS, as_of).groupBy(_PART, "digest").agg(F.count(F.lit(1)).alias("copies"))
    store(counted.hint("rebalance", F.col(_PART)), DIGESTS, _PART)
    lines = _day(spark, path, DIGESTS, as_of).groupBy(_PART).agg(
        F.sum("copies").alias("n"), _checksum(1).alias("low"), _checksum(16).alias("high")
    )
    store(lines.coalesce(1), PARTS)


def _day(spark: SparkSession, path: str, name: str, as_of: dt.date) -> DataFrame:
    folder = f"{_DAY}={as_of.isoformat()}"
    if name == DIGESTS:
        return spark.read.schema(f"digest string, copies bigint, {_PART} string").parquet(f"{path}/{name}/{folder}")
    if name == ROWS:
        shape = spark.read.parquet(f"{path}/{SHAPE}/{folder}").schema
        return spark.read.schema(shape).parquet(f"{path}/{name}/{folder}")
    return spark.read.parquet(f"{path}/{name}/{folder}")


def changed_parts(spark: SparkSession, path: str, old: dt.date, new: dt.date) -> list[str]:
    """Parts whose rows differ between two days; as many names as the extract has parts."""
    sides = [_day(spark, path, PARTS, day).select(_PART, F.struct("n", "low", "high").alias(name))
             for day, name in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], _PART, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r[_PART] for r in both.select(_PART).collect())


def snapshot_changes(spark: SparkSession, path: str, old: dt.date, new: dt.date) -> DataFrame:
    """Distinct rows whose number of copies changed, with ``copies``: more than zero added, less removed."""
    parts = changed_parts(spark, path, old, new)

    def of(name: str, day: dt.date) -> DataFrame:
        return _day(spark, path, name, day).where(F.col(_PART).isin(*parts) if parts else F.lit(False))

    # digests of the parts that differ; a row that moved between parts cancels out
    signed = of(DIGESTS, new).select("digest", "copies").union(of(DIGESTS, old).select("digest", -F.col("copies")))
    changed = signed.groupBy("digest").agg(F.sum("copies").alias("copies")).where("copies <> 0")
    rows = of(ROWS, new).drop(_PART).unionByName(of(ROWS, old).drop(_PART))
    found = rows.join(changed.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    return found.join(changed, "digest").drop("digest")


def bag_delta(new: DataFrame, old: DataFrame, part: str | None = None) -> DataFrame:
    """As :func:`snapshot_changes`, of two tables with the same columns that are not stored with digests.

    Copies count: what ``EXCEPT ALL`` gives both ways, with the numbers of copies.  With ``part``, a column of few
    values such as a day, rows of parts that are the same bag in both tables are left out before the shuffle;
    both tables are then read twice.
    """
    if part is not None:
        new, old = in_changed_parts(new, old, part, new.columns)
    signed = new.withColumn("copies", F.lit(1)).unionByName(old.withColumn("copies", F.lit(-1)))
    return signed.groupBy(*new.columns).agg(F.sum("copies").alias("copies")).where("copies <> 0")
