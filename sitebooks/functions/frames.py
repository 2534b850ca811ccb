"""Frame-level helpers: null-safe joins, total rows, ordered text lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined(
    left: DataFrame,
    right: DataFrame,
    on: Iterable[str | tuple[str, str]],
    how: str = "left",
) -> DataFrame:
    """Equi join where two unknown keys count as equal.

    ``on`` lists key names, or (left, right) pairs where they differ.  The right
    keys do not appear in the result.  Null-safe equality still plans as an equi
    join, and Spark's own size estimate decides about broadcasting: no side is
    forced.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    aside = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}
    right = right.withColumnsRenamed(aside)
    full = how == "full_outer"
    if full:
        left = left.withColumn("__in_left", F.lit(True))
    condition = reduce(and_, [left[l].eqNullSafe(right[aside[r]]) for l, r in pairs])
    result = left.join(right, condition, how)
    if how in ("left_semi", "left_anti"):
        return result
    if full:
        for l, r in pairs:
            key = F.when(F.col("__in_left"), F.col(l)).otherwise(F.col(aside[r]))
            result = result.withColumn(l, key)
        result = result.drop("__in_left")
    return result.drop(*aside.values())


def in_changed_parts(
    new: DataFrame, old: DataFrame, part: str, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables in the parts in which ``columns`` are not the same bag of rows.

    ``part`` is a column of few values (a day, a month), unknown is a part of its own.  A part is summed up as its
    number of rows and two sums of 64-bit hashes, apart for each table; only these lines are shuffled.  The names of
    the parts that differ are one row each and go to every task.
    """

    def lines(df: DataFrame, name: str) -> DataFrame:
        # hashes skip unknown values, so which values are unknown is hashed too
        nested = [c for c in columns if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType))]
        values = [F.to_json(c, {"ignoreNullFields": "false"}) if c in nested else F.col(c) for c in columns]
        row = [F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]), *values]
        sums = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(20,0)")) for seed in (1, 2)]
        return df.groupBy(F.col(part).alias("__part")).agg(F.struct(F.count(F.lit(1)), *sums).alias(name))

    a, b = lines(new, "__a"), lines(old, "__b")
    both = joined(a, b, ["__part"], "full_outer")
    changed = F.broadcast(both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("__part"))
    same = F.col(part).eqNullSafe(F.col("__part"))
    return new.join(changed, same, "left_semi"), old.join(changed, same, "left_semi")


def _total_row(df: DataFrame, label: str, by: Sequence[str], filler: str) -> list[Column]:
    """What a total row shows in each column; sums are expected under the columns' own names."""
    row = []
    for f in df.schema.fields:
        if f.name in by or isinstance(f.dataType, T.NumericType):
            row.append(F.col(f.name))
        elif f.name == label:
            row.append(F.lit("Total").alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            row.append(F.lit(filler).alias(f.name))
        else:
            row.append(F.lit(None).cast(f.dataType).alias(f.name))
    return row


def _numeric(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]


def append_total(
    df: DataFrame,
    label: str,
    by: Sequence[str] = (),
    filler: str = "-",
) -> DataFrame:
    """Append one total row (one per ``by`` group) to sums.

    ``label`` holds "Total", other texts hold ``filler``, numbers are summed with
    nulls skipped, anything else is null; at least one number is expected.  For frames that end in an
    aggregation: both branches share its shuffle, Spark reuses the exchange, so the source is read
    once.  Rows that are not aggregated go through :func:`append_total_to_rows`.
    """
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _numeric(df, by)]
    totals = (df.groupBy(*by) if by else df.groupBy()).agg(*sums)
    return df.unionByName(totals.select(*_total_row(df, label, by, filler)))


def append_total_to_rows(
    df: DataFrame,
    label: str,
    by: Sequence[str] = (),
    filler: str = "-",
) -> DataFrame:
    """Append one total row (one per ``by`` group) to plain rows, in one pass over them.

    The result is that of :func:`append_total`.  Rows and totals are two grouping sets of one aggregation:
    equal rows of a task are counted and repeated behind it (a task's copies are bounded by its input split, and
    copies all over the table stay spread), and the totals are summed up before the shuffle.
    Without ``by`` an empty frame still gets its total of zero.
    """
    numbers = _numeric(df, by)
    sums = {name: f"__sum_{i}" for i, name in enumerate(numbers)}
    rows = df.withColumns({"__task": F.spark_partition_id(), "__seed": F.lit(False)})
    if not by:  # a total over nothing needs something to add up: one row of nulls
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        seed = df.sparkSession.range(0, 1, 1, 1).select(*nulls, F.lit(0).alias("__task"), F.lit(True).alias("__seed"))
        rows = rows.union(seed)
    counted = rows.groupingSets([rows.columns, list(by)], *rows.columns).agg(
        F.count(F.lit(1)).alias("__copies"),
        F.grouping_id().alias("__set"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(aside) for name, aside in sums.items()],
    )
    is_total = F.col("__set") != 0
    totalled = []
    for f, shown in zip(df.schema.fields, _total_row(df, label, by, filler), strict=True):
        shown = F.col(sums[f.name]) if f.name in sums else shown
        totalled.append(F.when(is_total, shown).otherwise(F.col(f.name)).alias(f.name))
    copies = F.when(is_total, F.lit(1)).otherwise(F.col("__copies")).cast("bigint")
    wanted = counted.where(is_total | ~F.col("__seed"))
    return wanted.select(*totalled, F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("__copy")).drop("__copy")


def sorted_text(value: Column | str, separator: str = ",") -> Column:
    """Aggregate texts into one sorted list text; null if any input is null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(
        F.count(F.lit(1)) == F.count(value),
        F.array_join(F.array_sort(F.collect_list(value)), separator),
    )


def repeated_text(value: str, copies: str, separator: str = ",") -> Column:
    """As :func:`sorted_text`, over (text, count) rows that were counted first.

    The shuffled state is one entry per distinct text however often it occurs.
    """
    runs = F.array_sort(F.collect_list(F.struct(F.col(value), F.col(copies).cast("int").alias("n"))))
    texts = F.flatten(F.transform(runs, lambda r: F.array_repeat(r[value], r["n"])))
    return F.when(
        F.count(F.lit(1)) == F.count(F.col(value)), F.array_join(texts, separator)
    )
