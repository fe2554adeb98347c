"""Rolling metrics, decomposition, forecasts and outliers against plain Python and pandas."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import series

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(4)
    rows = []
    for i in range(900):
        # A third of all rows share one minute; some values are missing.
        minutes = 5000 if i % 3 == 0 else draw.randrange(40_000)
        rows.append((i, START + dt.timedelta(minutes=minutes), None if i % 50 == 7 else round(draw.uniform(-5, 50), 2)))
    frame = pd.DataFrame(rows, columns=["k", "t", "x"])
    return spark.createDataFrame(rows, "k bigint, t timestamp, x double").repartition(6), frame


@pytest.mark.parametrize(("block", "rows"), [(100_000, 7), (10, 7), (3, 7), (64, 64), (50, 1)])
def test_rolling_rows(events, monkeypatch, block, rows):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    df, frame = events
    got = series.rolling_rows(df, "t", "k", "x", rows).toPandas().set_index("k")
    ordered = frame.sort_values(["t", "k"]).set_index("k")["x"]
    window = ordered.rolling(rows, min_periods=1)
    got = got.loc[ordered.index]
    assert len(got) == len(frame)
    assert (got["window_rows"] == ordered.notna().rolling(rows, min_periods=1).sum()).all()
    for name, expected in (("rolling_mean", window.mean()), ("rolling_min", window.min()), ("rolling_max", window.max())):
        assert np.allclose(got[name].astype(float), expected, equal_nan=True)


@pytest.mark.parametrize("span", ["7 days", "90 minutes"])
def test_rolling_time(events, span):
    df, frame = events
    got = series.rolling_time(df, "t", "x", span).toPandas().set_index("time")
    known = frame.dropna().sort_values("t").set_index("t")["x"]
    window = known.rolling(pd.Timedelta(span))
    expected = pd.DataFrame({"n": window.count(), "s": window.sum()}).groupby(level=0).last()
    got = got.loc[expected.index]
    assert len(got) == known.index.nunique()
    assert (got["window_rows"] == expected["n"]).all() and np.allclose(got["rolling_sum"], expected["s"])


def test_no_window_holds_a_whole_series(events):
    df, _ = events
    for made in (series.rolling_rows(df, "t", "k", "x", 7), series.rolling_time(df, "t", "x", "7 days")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        # Only the short list of per-partition totals meets in one place.
        assert plan.count("Exchange SinglePartition") <= 1


def days_of(spark, values, name="a"):
    rows = [(name, (START + dt.timedelta(days=i)).date(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, day date, x double")


def test_daily_fills_gaps(spark):
    rows = [("a", START, 1.5), ("a", START, 2.0), ("a", START + dt.timedelta(days=3), None), ("b", START, float("nan")), (None, START, 1.0)]
    got = series.daily(spark.createDataFrame(rows, "s string, t timestamp, v double"), "s", "t", "v").orderBy("series", "day").collect()
    assert [(r.series, r.day.day, r.x) for r in got] == [("a", 1, 3.5), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 0.0), ("b", 1, 0.0)]


@pytest.mark.parametrize("robust", [False, True])
@pytest.mark.parametrize("period", [7, 4])
def test_planted_trend_and_season_are_recovered(spark, robust, period):
    n = 60
    season = np.array([3.0, -1.0, 0.0, 2.0, -4.0, 1.0, -1.0][:period])
    season = season - season.mean()
    first = (START.date() - dt.date(1970, 1, 1)).days
    line = 10 + 0.5 * np.arange(n)
    values = line + season[(first + np.arange(n)) % period]
    if robust:
        values[20] += 1000 if period == 7 else 0
    got = series.decompose(days_of(spark, values), period, robust).orderBy("day").toPandas()
    assert got["trend"].isna().sum() == 2 * (period // 2)
    inner = got.dropna()
    assert np.allclose(inner["trend"] + inner["seasonal"] + inner["remainder"], inner["x"])
    calm = inner[~inner.index.isin(range(20 - period, 21 + period))] if robust else inner
    assert np.allclose(calm["trend"], line[calm.index])
    assert np.allclose(got["seasonal"], season[(first + np.arange(n)) % period])


def holt(values, alpha, beta, origins):
    level, trend, off, naive = values[0], values[1] - values[0], [], []
    for before, x in zip(values, values[1:]):
        off.append(abs(x - level - trend))
        naive.append(abs(x - before))
        new = alpha * x + (1 - alpha) * (level + trend)
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    return level, trend, float(np.mean(off[-origins:])), float(np.mean(naive[-origins:]))


def test_forecasts_equal_a_plain_recursion(spark):
    draw = np.random.default_rng(2)
    tables = {"walk": np.cumsum(draw.normal(size=40)), "line": 3.0 * np.arange(12), "two": np.array([1.0, 4.0]), "flat": np.full(9, 2.0)}
    df = None
    for name, values in tables.items():
        part = days_of(spark, values, name)
        df = part if df is None else df.unionByName(part)
    df = df.unionByName(days_of(spark, [5.0], "one")).repartition(3)
    got = {}
    for r in series.forecast(df, 3, origins=5).collect():
        got.setdefault(r.series, {})[r.step] = r
    assert got.keys() == tables.keys()
    for name, values in tables.items():
        tries = [(round(holt(values, a, b, 5)[2], 9), a, b) for a in series.ALPHAS for b in series.BETAS]
        _, alpha, beta = min(tries)
        level, trend, mae, naive = holt(values, alpha, beta, 5)
        for step, r in got[name].items():
            assert (r.alpha, r.beta) == (alpha, beta)
            assert (r.mae, r.naive_mae, r.forecast) == (pytest.approx(mae), pytest.approx(naive), pytest.approx(level + step * trend))
    assert got["line"][1].mae == pytest.approx(0) and got["line"][1].naive_mae == pytest.approx(3)


def test_outliers_at_large_means(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=500) + 1e9
    x[17] += 50
    rows = [(i, "g" if i % 2 else None, float(v), 4.0) for i, v in enumerate(x)] + [(900, "g", None, 4.0), (901, "g", float("nan"), None)]
    df = spark.createDataFrame(rows, "k bigint, g string, x double, c double").repartition(4)
    got = {r.k: r for r in series.zscore_outliers(df, "k", ["x", "c"], "g").collect()}
    for part in (range(0, 500, 2), range(1, 500, 2)):
        values = x[list(part)]
        z = (values - values.mean()) / values.std(ddof=1)
        for i, score in zip(part, z):
            assert (i in got) == (abs(score) > 3)
            if i in got:
                assert got[i].z == pytest.approx(score, rel=1e-6) and got[i].column_name == "x"
    assert 17 in got
    whole = {r.k for r in series.zscore_outliers(df, "k", ["x"]).collect()}
    z = (x - x.mean()) / x.std(ddof=1)
    assert whole == {i for i in range(500) if abs(z[i]) > 3}
    assert series.zscore_outliers(df.where(F.col("k") < 0), "k", ["x"]).collect() == []
