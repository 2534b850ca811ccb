"""Whole-table order (running sums, previous rows) without a single-task window.

A window with an ``orderBy`` and no ``partitionBy`` moves every row into one task.
Here the rows are cut into ranges of the wanted order, each range is one window
partition, and what crosses a border (the sum so far, the last values so far) is
one small row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE, COPY = "__slice", "__copy"
# copies of one row that travel together before they are spread out again
CHUNK = 1000
# rows of a range: the number of ranges follows the number of rows
SLICE_ROWS = 200_000


class OrderedRows:
    """Rows cut into ranges of a total order.

    The cut is checkpointed: range borders come from a sample and must be the same
    for the rows and for what is carried over the borders, also after a lost
    executor.  Unless ``slices`` is given, the rows are checkpointed and counted before the cut, so that
    what they are derived from is computed once and a range has about ``SLICE_ROWS`` rows at any size.

    With ``unique`` the order keys identify a row.  Otherwise identical rows are
    counted and numbered, which makes the order total and the same in every run;
    a row with very many copies is cut into chunks that different ranges can hold.
    ``order`` should then name all columns that matter, since rows that tie in it
    but differ elsewhere keep no particular order.
    """

    def __init__(
        self, df: DataFrame, order: Sequence[Column], unique: bool = False, slices: int | None = None
    ):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        self.columns = df.columns
        if unique:
            self.order = list(order)
            cut, held = df, F.lit(1)
        else:
            self.order = [*order, F.col(COPY).asc()]
            cut = (
                df.groupBy(*df.columns)
                .agg(F.count(F.lit(1)).alias("__n"))
                .withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col("__n"), F.lit(CHUNK))))
            )
            held = F.least(F.col("__n") - F.col(COPY) + 1, F.lit(CHUNK))
        if slices is None:
            cut = cut.checkpoint()
            slices = -(-(cut.agg(F.sum(held)).first()[0] or 1) // SLICE_ROWS)
        # one range has no borders: it needs no cut, and nothing is carried over
        self.whole = slices == 1
        ranged = cut if self.whole else cut.repartitionByRange(slices, *self.order)
        if not unique:
            last = F.least(F.col("__n"), F.col(COPY) + (CHUNK - 1))
            ranged = ranged.withColumn(COPY, F.explode(F.sequence(F.col(COPY), last))).drop("__n")
        if self.whole:
            self.rows = ranged.withColumn(SLICE, F.lit(0))
            return
        self.rows = ranged.withColumn(SLICE, F.spark_partition_id()).checkpoint()

    def running_total(self, value: str, into: str) -> DataFrame:
        """``value`` summed from the first row to each row."""
        sums = self.rows.groupBy(SLICE).agg(F.sum(value).alias("__sum"))
        # one row per slice: a window over all of them is bounded by the slice count
        earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(
            F.col(SLICE).alias("__s"),
            F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
        )
        within = Window.partitionBy(SLICE).orderBy(*self.order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        placed = self.rows.withColumn("__run", F.sum(value).over(within))
        if self.whole:
            return placed.select(*self.columns, F.col("__run").alias(into))
        return placed.join(F.broadcast(before), placed[SLICE] == before["__s"]).select(
            *self.columns, (F.col("__before") + F.col("__run")).alias(into)
        )

    def with_previous(self, value: str, depth: int, prefix: str) -> DataFrame:
        """Values of the ``depth`` rows before each row: ``prefix1`` ... ``prefixN``."""
        within = Window.partitionBy(SLICE).orderBy(*self.order)
        lags = [f"__lag{k}" for k in range(1, depth + 1)]
        placed = self.rows.withColumns(
            {"__pos": F.row_number().over(within)}
            | {name: F.lag(value, k).over(within) for k, name in enumerate(lags, 1)}
        )
        if self.whole:
            return placed.select(*self.columns, *[F.col(name).alias(f"{prefix}{k}") for k, name in enumerate(lags, 1)])
        # the last row of a slice with its own lags is the tail of the slice, nearest first
        tail = F.max_by(F.array(value, *lags[:-1]), "__pos")
        tails = placed.groupBy(SLICE).agg(
            F.slice(tail, F.lit(1), F.least(F.max("__pos"), F.lit(depth))).alias("__tail")
        )
        # each slice has a row, so ``depth`` earlier slices hold all that is needed
        earlier = Window.orderBy(SLICE).rowsBetween(-depth, -1)
        carried = tails.select(
            F.col(SLICE).alias("__s"),
            F.flatten(F.reverse(F.collect_list("__tail").over(earlier))).alias("__carry"),
        )
        full = placed.join(F.broadcast(carried), placed[SLICE] == carried["__s"])
        previous = [
            F.when(F.col("__pos") > k, F.col(name))
            .otherwise(F.get("__carry", F.lit(k) - F.col("__pos")))
            .alias(f"{prefix}{k}")
            for k, name in enumerate(lags, 1)
        ]
        return full.select(*self.columns, *previous)
