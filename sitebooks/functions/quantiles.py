"""Exact quantiles over rows by distributed selection.

Equal values are counted first (partial counts, then a shuffle by value), the counted values are cut into
ranges, and running counts over the ranges tell which value holds which rank.  Only the values at the
wanted ranks are kept, so no task holds all values of a group, however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import OrderedRows


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of ``value``, one row per ``by`` group (one row in all without).

    ``wanted`` names each result column and its share.  The rank is share * (n - 1), between two ranks the
    values are interpolated linearly.  Unknown values do not count; a group of unknown values only has
    null quantiles, and so has an empty table without ``by``.  Unknown keys are a group.
    """
    for name, share in wanted.items():
        if not 0 <= share <= 1:
            raise ValueError(f"{name}: {share} is no share")
    known = df.where(F.col(value).isNotNull())
    counted = known.groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    order = [*[F.asc_nulls_first(k) for k in by], F.col("__value").asc()]
    placed = OrderedRows(counted, order, unique=True).running_total("__n", "__until")
    first = (F.col("__until") - F.col("__n")).alias("__first")
    placed = placed.select(*by, F.col("__value").cast("double").alias("__value"), first, "__until")
    if by:
        keys = {k: f"__key_{i}" for i, k in enumerate(by)}
        groups = placed.groupBy(*by).agg(F.min("__first").alias("__base"), F.max("__until").alias("__end"))
        same = reduce(and_, [placed[k].eqNullSafe(F.col(aside)) for k, aside in keys.items()])
        placed = placed.join(groups.withColumnsRenamed(keys), same).drop(*keys.values())
    else:
        base, end = F.lit(0), placed.agg(F.max("__until")).scalar()
        placed = placed.withColumns({"__base": base, "__end": end})
    within = {"__low": F.col("__first") - F.col("__base"), "__high": F.col("__until") - F.col("__base")}
    placed = placed.withColumns(within | {"__last": F.col("__end") - F.col("__base") - 1})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__low") <= rank) & (rank < F.col("__high")), F.col("__value")))

    parts = []
    for i, share in enumerate(wanted.values()):
        rank = F.col("__last") * F.lit(float(share))
        parts += [
            at(F.floor(rank)).alias(f"__floor_{i}"),
            at(F.ceil(rank)).alias(f"__ceil_{i}"),
            F.max(rank - F.floor(rank)).alias(f"__part_{i}"),
        ]
    chosen = placed.groupBy(*by).agg(*parts)
    results = [
        (F.col(f"__floor_{i}") + (F.col(f"__ceil_{i}") - F.col(f"__floor_{i}")) * F.col(f"__part_{i}")).alias(name)
        for i, name in enumerate(wanted)
    ]
    found = chosen.select(*by, *results)
    if not by:
        return found
    # groups that hold unknown values only
    groups = df.select(*by).distinct().withColumnsRenamed({k: f"__key_{k}" for k in by})
    same = reduce(and_, [groups[f"__key_{k}"].eqNullSafe(found[k]) for k in by])
    names = [F.col(f"__key_{k}").alias(k) for k in by]
    return groups.join(found, same, "left").select(*names, *wanted)
