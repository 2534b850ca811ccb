"""Calendar-based forecast of a daily series: split, features, model, accuracy."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import OrderedRows
from .regression import LinearModel, fit_elastic_net

# Length of the test period and of the forecast, penalty of the model.
MONTHS, PENALTY = 3, 0.01
# Day numbers count from here; the fit does not depend on it.
ORIGIN = "2000-01-01"


def ts_split(series: DataFrame, months: int = MONTHS) -> DataFrame:
    """Mark the last months as test, everything before as training."""
    cut = series.agg(F.add_months(F.max("date"), -months)).scalar()
    return series.withColumn("part", F.when(F.col("date") > cut, "test").otherwise("train"))


def ts_features(series: DataFrame) -> DataFrame:
    """Weekday, month and day number of each date."""
    return series.withColumns(
        {
            "weekday": F.date_format("date", "EEE"),
            "month": F.date_format("date", "MMM"),
            "day_number": F.unix_date("date"),
        }
    )


@cache
def polynomial_contrasts(levels: int) -> tuple[tuple[float, ...], ...]:
    """Orthonormal polynomials of degree 1, 2, ... over ``levels`` equally spaced points, one row per level.

    The coding of an ordered factor: its columns are orthogonal to the mean, so no level is left out.
    """
    points = np.arange(levels) - (levels - 1) / 2
    basis, heights = np.linalg.qr(np.vander(points, increasing=True))
    coded = basis * np.sign(np.diag(heights))
    return tuple(tuple(row) for row in coded[:, 1:].tolist())


def calendar_features(date: str = "date") -> dict[str, Column]:
    """Weekday (from Sunday) and month as ordered factors, and the day number."""
    out: dict[str, Column] = {}
    for name, place, levels in (("weekday", F.dayofweek(date), 7), ("month", F.month(date), 12)):
        for degree, column in enumerate(zip(*polynomial_contrasts(levels), strict=True), 1):
            out[f"{name}_{degree}"] = F.element_at(F.array(*[F.lit(x) for x in column]), place)
    out["day_number"] = F.datediff(F.col(date), F.lit(ORIGIN).cast("date")).cast("double")
    return out


def fit_glm(train: DataFrame, penalty: float = PENALTY) -> LinearModel:
    """Penalised linear model on weekday, month and day number; days without a value are left out."""
    return fit_elastic_net(train, calendar_features(), F.col("value").cast("double"), penalty)


def predict(model: LinearModel, series: DataFrame) -> DataFrame:
    return series.withColumn("predicted", model.prediction(calendar_features()))


def ts_glm(series: DataFrame) -> DataFrame:
    """Test period with the prediction of a model fitted on the training period."""
    split = ts_split(series)
    model = fit_glm(split.where("part = 'train'"))
    return predict(model, split.where("part = 'test'")).drop("part")


def ts_glm_terms(series: DataFrame) -> DataFrame:
    """The fitted terms of the training period with the optimality condition each one meets."""
    return fit_glm(ts_split(series).where("part = 'train'")).terms(series.sparkSession)


def future_days(series: DataFrame, months: int = MONTHS) -> DataFrame:
    """The days of the months after the last observed day."""
    last = series.agg(F.max("date").alias("last"))
    return last.select(
        F.explode(F.sequence(F.date_add("last", 1), F.add_months("last", months))).alias("date")
    )


def ts_future(series: DataFrame, months: int = MONTHS) -> DataFrame:
    """Forecast of the next months from a model fitted on the whole series."""
    return predict(fit_glm(series), future_days(series, months))


def seasonal_naive(series: DataFrame, days: int = 7) -> DataFrame:
    """Predict each day by the value of the same weekday before."""
    before = series.select(F.date_add("date", days).alias("date"), F.col("value").alias("predicted"))
    return series.join(before, "date")


def ts_accuracy(predictions: DataFrame) -> DataFrame:
    """Error measures of predicted against actual values, over the given days."""
    actual, predicted = F.col("value").cast("double"), F.col("predicted").cast("double")
    placed = OrderedRows(predictions, [F.asc_nulls_last("date")], unique=True).with_previous("value", 1, "before")
    error = F.abs(actual - predicted)
    step = F.abs(actual - F.col("before1").cast("double"))
    mae = F.avg(error)
    return placed.agg(
        mae.alias("mae"),
        (100 * F.avg(F.try_divide(error, F.abs(actual)))).alias("mape"),
        F.try_divide(mae, F.avg(step)).alias("mase"),
        (100 * F.avg(F.try_divide(2 * error, F.abs(actual) + F.abs(predicted)))).alias("smape"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.pow(F.corr(actual, predicted), 2.0).alias("rsq"),
    )
