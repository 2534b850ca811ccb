"""The catalogue of named queries and the SQL each is checked with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tune
from ..sources import ledger, view, with_views

# the day every report is run for: one day after the last transaction
AS_OF = dt.date(2001, 11, 5)


@dataclass(frozen=True)
class Tables:
    """The business tables of one folder."""

    spark: SparkSession
    folder: str

    def ledger(self, *columns: str) -> DataFrame:
        return ledger(self.spark, self.folder, *columns)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}
# steps the checking SQL of several keys shares
STEPS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if key in CATALOGUE:
            raise ValueError(f"query {key} is registered twice")
        CATALOGUE[key] = Query(build, sql)
        return build

    return register


def publish(df: DataFrame) -> DataFrame:
    """Exact decimals inside, plain doubles (six decimals) for the reader."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            exact = F.round(f.name, 6) if f.dataType.scale > 6 else F.col(f.name)
            out.append(exact.cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(f.name, 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, folder: publish(build(Tables(tune(spark), folder)))

    return {key: runner(q.build) for key, q in CATALOGUE.items()}


def checking_sql() -> dict[str, str]:
    return {key: with_views(q.sql, STEPS) for key, q in CATALOGUE.items() if q.sql}
