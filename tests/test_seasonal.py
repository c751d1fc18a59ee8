from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import seasonal


def planted(days=2_000, change=0.4, noise=0.2, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(days) / (days - 1)
    trend = 10 + 20 * t - 32 * np.maximum(t - change, 0)
    position = np.arange(days) + 15_000.0
    season = 0.5 * np.sin(2 * np.pi * position / seasonal.YEAR_DAYS) + 0.2 * np.cos(2 * np.pi * position / 7)
    return t, trend, trend * (1 + season), trend * (1 + season) + noise * rng.normal(size=days)


def frame(spark, y, parts=6):
    start = date(1970, 1, 1) + timedelta(days=15_000)
    return spark.createDataFrame([(start + timedelta(days=i), float(v)) for i, v in enumerate(y)], "ds date, y double").repartition(parts)


def test_recovers_a_change_point_and_multiplied_seasons(spark):
    t, trend, truth, y = planted()
    model = seasonal.fit_seasonal(frame(spark, y), "ds", "y")
    slope = model.scale * (model.trend[1] + np.cumsum(np.concatenate(([0.0], model.trend[2:]))))
    edges = np.concatenate(([0.0], model.knots))
    before, after = slope[edges < 0.33], slope[edges > 0.47]
    assert before == pytest.approx(20, abs=2) and after == pytest.approx(-12, abs=2)
    assert np.abs(model.season[:2]) == pytest.approx([0.5, 0], abs=0.03)
    changes = np.abs(model.trend[2:])
    assert np.sum(changes > 0.05 * changes.max()) <= 4
    got = seasonal.predict_seasonal(model, frame(spark, y), "ds").orderBy("ds").toPandas()["yhat"].to_numpy()
    assert np.sqrt(np.mean((got - truth) ** 2)) < 0.25
    assert got == pytest.approx(np.maximum(model.estimate(np.arange(2_000) + 15_000.0), 0), abs=1e-9)


def test_gram_matrix_is_that_of_all_days(spark):
    y = planted(300)[3]
    days = frame(spark, y).select(seasonal.day_index(F.col("ds")).cast("double").alias("position"), F.col("y").alias("amount"))
    knots = np.linspace(0, 0.8, 26)[1:]
    got = seasonal.gram(days, 15_000.0, 299.0, 2.0, knots)
    position = np.arange(300) + 15_000.0
    pairs = np.einsum("na,nb->nab", seasonal.trend_rows((position - 15_000) / 299, knots), seasonal.season_rows(position)).reshape(300, -1)
    z = np.column_stack([pairs, y / 2])
    assert got == pytest.approx(z.T @ z, abs=1e-7)


def test_coordinate_descent_meets_the_conditions_of_a_minimum():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 6)), rng.normal(size=50)
    lasso, ridge = np.array([0, 0, 3.0, 3, 3, 30]), np.full(6, 0.5)
    x = seasonal.descend(a.T @ a, a.T @ b, lasso, ridge, np.zeros(6))
    slope = a.T @ (a @ x - b) + ridge * x
    assert np.all(np.abs(slope[x != 0] + lasso[x != 0] * np.sign(x[x != 0])) < 1e-6)
    assert np.all(np.abs(slope[x == 0]) <= lasso[x == 0] + 1e-6) and x[5] == 0


def test_odd_days(spark):
    empty = spark.createDataFrame([(None, 1.0), (date(2024, 1, 1), None)], "ds date, y double")
    assert seasonal.predict_seasonal(seasonal.fit_seasonal(empty, "ds", "y"), empty, "ds").agg(F.max("yhat")).first()[0] == 0
    one = spark.createDataFrame([(date(2024, 1, 1), 4.0)] * 3, "ds date, y double")
    assert seasonal.predict_seasonal(seasonal.fit_seasonal(one, "ds", "y"), one, "ds").first()["yhat"] == pytest.approx(4, abs=0.5)
