"""The penalised linear model: one aggregation, optimality conditions, ordered factors."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitebooks.operators import forecast
from sitebooks.operators.regression import fit_elastic_net


def series(spark, n=800, seed=1):
    rng = random.Random(seed)
    start = dt.date(2019, 1, 3)
    rows = []
    for i in range(n):
        day = start + dt.timedelta(days=i)
        rows.append((day, 50 + 3 * (day.weekday() == 5) - 4 * math.cos(day.month / 2) + i / 100 + rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "date date, value double")


def test_contrasts_are_orthonormal_polynomials():
    # the published values for three and four ordered levels
    root = math.sqrt
    assert np.allclose(forecast.polynomial_contrasts(3), [[-1 / root(2), 1 / root(6)], [0, -2 / root(6)], [1 / root(2), 1 / root(6)]])
    four = np.array(forecast.polynomial_contrasts(4))
    assert np.allclose(four[:, 0], np.array([-3, -1, 1, 3]) / root(20))
    for k in (7, 12):
        coded = np.array(forecast.polynomial_contrasts(k))
        assert np.allclose(coded.T @ coded, np.eye(k - 1)) and np.allclose(coded.sum(axis=0), 0)
        assert (coded[-1] > 0).all()


def test_no_penalty_is_least_squares(spark):
    df = series(spark)
    model = forecast.fit_glm(df, penalty=0.0)
    features = forecast.calendar_features()
    rows = np.array(df.select(*features.values(), "value").collect(), float)
    design = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
    best = np.linalg.lstsq(design, rows[:, -1], rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients.values()], best, atol=1e-6)


@pytest.mark.parametrize("mixture", [1.0, 0.4])
def test_optimality_conditions_hold_on_the_rows(spark, mixture):
    """Recomputed from the rows, not from the sums: every term meets its condition, and some are exactly zero."""
    df, penalty = series(spark), 0.3
    features = forecast.calendar_features()
    model = fit_elastic_net(df, features, F.col("value"), penalty, mixture)
    rows = np.array(df.select(*features.values(), "value").collect(), float)
    x, y = rows[:, :-1], rows[:, -1]
    b = np.array(list(model.coefficients.values()))
    residual = y - model.intercept - x @ b
    assert abs(residual.mean()) < 1e-9
    spread = x.std(axis=0)
    slack = (x - x.mean(axis=0)).T @ residual / len(y) / spread - penalty * (1 - mixture) * b * spread
    assert np.allclose(slack, list(model.gradient.values()), atol=1e-8)
    bound = penalty * mixture
    assert (np.abs(slack) <= bound + 1e-8).all()
    assert np.allclose(slack[b != 0], bound * np.sign(b[b != 0]), atol=1e-8)
    assert 0 < (b == 0).sum() < len(b)


def test_the_fit_reads_the_rows_once_and_does_not_depend_on_partitions(spark):
    df = series(spark)
    one, many = forecast.fit_glm(df.repartition(1)), forecast.fit_glm(df.repartition(13))
    assert np.allclose(list(one.coefficients.values()), list(many.coefficients.values()), atol=1e-9)


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], "date date, value double")
    model = forecast.fit_glm(empty)
    assert model.intercept is None and set(model.coefficients.values()) == {0.0}
    assert forecast.predict(model, series(spark, 3)).where("predicted is not null").count() == 0
    # a single day, repeated, with unknown values and days: features are constant, the mean is the prediction
    rows = [(dt.date(2020, 5, 5), 4.0), (dt.date(2020, 5, 5), 6.0), (dt.date(2020, 5, 6), None), (None, 9.0)]
    df = spark.createDataFrame(rows, "date date, value double")
    model = forecast.fit_glm(df)
    assert model.intercept == pytest.approx(5.0) and set(model.coefficients.values()) == {0.0}
    got = [r.predicted for r in forecast.predict(model, df).collect()]
    assert got[0] == pytest.approx(5.0) and got[3] is None


def test_forecast_follows_the_calendar(spark):
    df = series(spark)
    out = forecast.ts_glm(df)
    assert out.columns == ["date", "value", "predicted"]
    error = out.agg(F.avg(F.abs(F.col("value") - F.col("predicted")))).first()[0]
    assert error < 1.6
    future = forecast.ts_future(df)
    last = df.agg(F.max("date")).first()[0]
    assert future.agg(F.min("date")).first()[0] == last + dt.timedelta(days=1)
    assert future.where("predicted is null").count() == 0
    terms = forecast.ts_glm_terms(df).collect()
    assert len(terms) == 19 and all(abs(t.gradient) <= t.bound + 1e-9 for t in terms[1:])
