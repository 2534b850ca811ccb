"""Results that a failed or repeated write cannot damage.

Every write of a result goes to a folder of its own run.  Only when all its tables are there, one line is
appended to the manifest; readers follow the last line.  A write that fails leaves the line of the run
before, a write that is repeated under its run id replaces its own folder, and tables of one run
change over together.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, RUNS = "manifest", "runs"
_LINE = "run string, place bigint, tables array<string>"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LINE).json(f"{path}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_run(spark: SparkSession, path: str) -> str | None:
    """The run that readers see, or none."""
    lines = _manifest(spark, path)
    if lines is None:
        return None
    last = lines.agg(F.max(F.struct("place", "run")).alias("last")).first()["last"]
    return None if last is None else last["run"]


def publish_run(
    tables: Mapping[str, DataFrame], path: str, run: str | None = None, keys: Mapping[str, Sequence[str]] | None = None
) -> str:
    """Write a named set of tables and make them the current result; returns the run id.

    ``keys`` names the folder columns of tables that get one folder per key.  Giving the same ``run`` again replaces
    that run, as after a failure.
    """
    run = run or uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        by = list((keys or {}).get(name, ()))
        rows = df.hint("rebalance", *[F.col(k) for k in by]) if by else df
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{RUNS}/{run}/{name}")
    if spark is None:
        raise ValueError("no tables to publish")
    lines = _manifest(spark, path)
    place = 0 if lines is None else (lines.agg(F.max("place")).first()[0] or 0)
    line = spark.createDataFrame([(run, place + 1, list(tables))], _LINE).coalesce(1)
    line.write.mode("append").json(f"{path}/{MANIFEST}")
    return run


def read_run(spark: SparkSession, path: str, name: str, run: str | None = None) -> DataFrame:
    """A table of the current run, or of a run that is named."""
    run = run or current_run(spark, path)
    if run is None:
        raise FileNotFoundError(f"no run was published below {path}")
    return spark.read.parquet(f"{path}/{RUNS}/{run}/{name}")
