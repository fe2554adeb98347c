"""Exact quantiles by brackets, against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import brackets

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    draw = np.random.default_rng(5)
    n = 4000
    tables = {
        "spread": draw.normal(size=n),
        "hot": np.where(draw.random(n) < 0.4, 7.0, draw.integers(0, 20, n)),
        "two": draw.integers(0, 2, n).astype(float),
        "same": np.full(n, 3.25),
        "tails": np.exp(draw.normal(size=n) * 20),
        "sorted": np.arange(n) * 1.0 - 1e9,
        "ends": np.where(draw.random(n) < 0.01, np.inf, draw.random(n)),
    }
    rows = [tuple(float(tables[c][i]) for c in tables) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in tables)).repartition(5)
    return df, tables


@pytest.mark.parametrize(("keep", "accuracy"), [(100_000, 10_000), (100, 10_000), (10, 40), (0, 50)])
def test_equals_numpy(numbers, monkeypatch, keep, accuracy):
    """Also where sketches are coarse and brackets are refined many times."""
    df, tables = numbers
    monkeypatch.setattr(brackets, "KEEP", keep)
    monkeypatch.setattr(brackets, "ACCURACY", accuracy)
    got = {(r.column_name, r.probability): (r.quantile, r.n) for r in brackets.quantiles_of(df, list(tables), PROBABILITIES).collect()}
    assert len(got) == len(tables) * len(PROBABILITIES)
    for name, values in tables.items():
        for p in PROBABILITIES:
            ordered, at = np.sort(values), (len(values) - 1) * p
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            expected = low if low == high else low + (high - low) * (at - math.floor(at))
            quantile, n = got[name, p]
            assert n == len(values)
            assert quantile == expected or math.isclose(quantile, expected, rel_tol=1e-12), (name, p)


def test_a_wrong_sketch_does_no_harm(numbers, monkeypatch):
    df, tables = numbers
    honest = brackets._sketched
    calls = []

    def misled(x, wanted):
        calls.append(len(wanted))
        edges = honest(x, wanted)
        return [(e[0], e[0]) for e in edges] if len(calls) % 2 else [(e[1], e[1]) for e in edges]

    monkeypatch.setattr(brackets, "KEEP", 50)
    monkeypatch.setattr(brackets, "_sketched", misled)
    got = {r.probability: r.quantile for r in brackets.quantiles_of(df, ["spread"], [0.3, 0.5]).collect()}
    assert got == {p: pytest.approx(np.quantile(tables["spread"], p), rel=1e-12) for p in (0.3, 0.5)}


def test_one_row_nulls_and_nothing(spark):
    df = spark.createDataFrame([(4.0, None), (None, None), (math.nan, math.nan)], "a double, b double")
    got = [(r.column_name, r.quantile, r.n) for r in brackets.quantiles_of(df, ["a", "b"], [0.5]).collect()]
    assert got == [("a", 4.0, 1)]
    assert brackets.quantiles_of(df.limit(0), ["a"], [0.5]).collect() == []
    assert brackets.quantiles_of(df, [], [0.5]).collect() == []


def test_only_the_bracket_is_grouped(spark, monkeypatch):
    """What is grouped doesn't grow with the rows."""
    monkeypatch.setattr(brackets, "KEEP", 1000)
    seen = []
    gathered = brackets._gathered
    monkeypatch.setattr(brackets, "_gathered", lambda x, wanted: (seen.append(sum(r.inside for r in wanted)), gathered(x, wanted)))
    for n in (20_000, 200_000):
        brackets.quantiles_of(spark.range(n).select(F.rand(1).alias("v")), ["v"], [0.5])
    assert max(seen) <= 2 * 1000


def test_a_bracket_is_sketched_once(numbers, monkeypatch):
    """However many ranks are wanted of it."""
    df, tables = numbers
    monkeypatch.setattr(brackets, "KEEP", 100)
    sketches, honest = [], F.percentile_approx
    monkeypatch.setattr(brackets.F, "percentile_approx", lambda *a: (sketches.append(a), honest(*a))[1])
    got = {r.probability: r.quantile for r in brackets.quantiles_of(df, ["spread"], [0.1, 0.3, 0.5, 0.7]).collect()}
    assert got == {p: pytest.approx(np.quantile(tables["spread"], p), rel=1e-12) for p in got} and len(got) == 4
    assert len(sketches) == 1
