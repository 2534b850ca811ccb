"""Linear models from one aggregation.

What a penalised least-squares fit needs of the rows is their number, means, and the products of
features and target summed up: p * (p + 3) / 2 numbers for p features, whatever the number of rows.
Partial sums make them in one pass; the coordinate descent works on these numbers alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest violation of the optimality conditions, as a share of the target's deviation.
TOLERANCE = 1e-11
MOST_SWEEPS = 100_000


@dataclass(frozen=True)
class LinearModel:
    """Intercept and coefficients, with the optimality conditions of the standardised problem.

    ``gradient`` is the correlation of a standardised feature with what the model leaves unexplained,
    less the ridge part: it equals ``bound`` times the sign of a non-zero coefficient and is at most ``bound``
    in size for a zero one.
    """

    intercept: float | None
    coefficients: dict[str, float]
    gradient: dict[str, float]
    bound: float

    def prediction(self, features: Mapping[str, Column]) -> Column:
        """Null where the model was fitted on no rows or a feature is null."""
        total = F.lit(self.intercept).cast("double")
        for name, coefficient in self.coefficients.items():
            total = total + F.lit(coefficient) * features[name]
        return total

    def terms(self, spark: SparkSession) -> DataFrame:
        """One row per term: the intercept, then the features."""
        rows = [("(intercept)", self.intercept, None, self.bound)]
        rows += [(name, value, self.gradient[name], self.bound) for name, value in self.coefficients.items()]
        return spark.createDataFrame(rows, "term string, coefficient double, gradient double, bound double")


def _moments(df: DataFrame, features: Mapping[str, Column], target: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of complete rows, sums, and sums of products, of the features and, last, the target."""
    columns = [c.cast("double").alias(f"x{i}") for i, c in enumerate([*features.values(), target])]
    rows = df.select(*columns).na.drop("any")
    names = rows.columns
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(
        F.count(F.lit(1)),
        *[F.sum(c) for c in names],
        *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs],
    ).first()
    n, p = found[0], len(names)
    if n == 0:
        return 0, np.zeros(p), np.zeros((p, p))
    products = np.zeros((p, p))
    for (i, j), value in zip(pairs, found[1 + p :], strict=True):
        products[i, j] = products[j, i] = value
    return n, np.array(found[1 : 1 + p], float), products


def _descend(corr: np.ndarray, cross: np.ndarray, l1: float, l2: float, scale: float) -> np.ndarray:
    """Cyclic coordinate descent on the standardised problem until the optimality conditions hold."""
    beta = np.zeros(len(cross))
    for _ in range(MOST_SWEEPS):
        for j in range(len(beta)):
            if corr[j, j] == 0.0:
                continue
            left = cross[j] - corr[j] @ beta + corr[j, j] * beta[j]
            beta[j] = np.sign(left) * max(abs(left) - l1, 0.0) / (corr[j, j] + l2) + 0.0
        slack = cross - corr @ beta - l2 * beta
        broken = np.where(beta != 0, np.abs(slack - l1 * np.sign(beta)), np.maximum(np.abs(slack) - l1, 0.0))
        if broken[np.diag(corr) > 0].max(initial=0.0) <= TOLERANCE * scale:
            return beta
    raise RuntimeError("the coordinate descent did not meet the optimality conditions")


def fit_elastic_net(
    df: DataFrame, features: Mapping[str, Column], target: Column, penalty: float, mixture: float = 1.0
) -> LinearModel:
    """Least squares with a penalty on standardised features, the intercept free.

    Minimises sum(residual ** 2) / (2n) + penalty * (mixture * sum|b| + (1 - mixture) / 2 * sum(b ** 2)).  Rows with
    a null are left out, a constant feature gets a zero; without rows the intercept is null.  The result
    does not depend on the order of the rows beyond the rounding of sums.
    """
    n, sums, products = _moments(df, features, target)
    names, l1, l2 = list(features), penalty * mixture, penalty * (1 - mixture)
    if n == 0:
        return LinearModel(None, dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), l1)
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    variance = np.diag(covariance)
    # a constant column's variance is what rounding left of it
    known = variance > 1e-12 * np.maximum(np.diag(products) / n, 1e-300)
    deviation = np.where(known, np.sqrt(np.maximum(variance, 0.0)), 1.0)
    corr = covariance / np.outer(deviation, deviation)
    corr[~known] = corr[:, ~known] = 0.0
    cross = corr[:-1, -1] * deviation[-1]
    beta = _descend(corr[:-1, :-1], cross, l1, l2, deviation[-1])
    slack = cross - corr[:-1, :-1] @ beta - l2 * beta
    coefficients = beta / deviation[:-1]
    intercept = float(mean[-1] - coefficients @ mean[:-1])
    return LinearModel(
        intercept,
        dict(zip(names, coefficients.tolist(), strict=True)),
        dict(zip(names, slack.tolist(), strict=True)),
        l1,
    )
