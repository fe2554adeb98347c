from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import tails
from tallyloom.operators import stats


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    df = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=300), "c": rng.integers(0, 4, 300).astype(float)})
    df.loc[:30, "c"] = None
    df["k"] = range(300)
    df["g"] = np.where(df["k"] % 3 == 0, "x", np.where(df["k"] % 3 == 1, "y", "z"))
    return df


@pytest.fixture(scope="module")
def frame(spark, numbers):
    clean = numbers.astype(object).where(numbers.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "a double, b double, c double, k int, g string").repartition(5)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_match_pandas(frame, numbers, method):
    want = numbers[["a", "b", "c"]].dropna().corr(method=method)
    got = {(r.var1, r.var2): r.correlation for r in stats.correlation_matrix(stats.correlation_pairs(frame, ["a", "b", "c"], method)).collect()}
    assert len(got) == 9
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_wide_tables_and_nan(spark):
    """Many columns share the one aggregate; a row with NaN counts as little as one with null."""
    rng = np.random.default_rng(4)
    names = [f"c{i}" for i in range(25)]
    data = rng.normal(size=(40, 25))
    data[3, 5] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    want = np.corrcoef(np.delete(data, 3, axis=0).T)
    got = stats.correlation_pairs(df).collect()
    assert len(got) == 300 and {r.rows for r in got} == {39}
    assert all(abs(r.correlation - want[r.i, r.j]) < 1e-9 for r in got)


def test_top_pairs(frame):
    top = stats.top_correlations(stats.correlation_pairs(frame, ["a", "b", "c"])).collect()
    assert (top[0].var1, top[0].var2, top[0].relationship) == ("a", "b", "Strong Positive")
    (key,) = stats.key_correlation(stats.correlation_pairs(frame, ["a", "b", "c"])).collect()
    assert key.var2 == "b" and key.rows == 269


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert stats.top_correlations(stats.correlation_pairs(df)).collect() == []


def test_tail_probabilities():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074)
    assert tails.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert tails.f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_upper(10.0, 2) == pytest.approx(math.exp(-5))
    assert tails.chi2_upper(60.0, 30) == pytest.approx(sum(math.exp(-30) * 30**k / math.factorial(k) for k in range(15)))
    # t with one degree of freedom is Cauchy
    for t in (0.1, 1.0, 30.0, 1e6):
        assert tails.t_two_sided(t, 1) == pytest.approx(2 * (0.5 - math.atan(t) / math.pi), rel=1e-6)


def test_welch(frame, numbers):
    two = frame.where("g <> 'z'")
    (r,) = rows(stats.welch_ttest(two, "g", "a"))
    x, y = numbers.loc[numbers.g == "x", "a"], numbers.loc[numbers.g == "y", "a"]
    se = x.var() / len(x) + y.var() / len(y)
    assert r["statistic"] == pytest.approx((x.mean() - y.mean()) / math.sqrt(se))
    assert 0 < r["p_value"] <= 1
    assert rows(stats.welch_ttest(frame, "g", "a")) == []
    assert rows(stats.welch_ttest(two.where("k < 8"), "g", "a")) == []


def test_anova_of_two_identical_shapes(spark, frame, numbers):
    (r,) = rows(stats.anova_oneway(frame, "g", "b"))
    groups = [g["b"].to_numpy() for _, g in numbers.groupby("g")]
    grand = np.concatenate(groups).mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 297
    assert r["statistic"] == pytest.approx(between / within) and (r["dof1"], r["dof2"]) == (2, 297)
    assert rows(stats.anova_oneway(frame.where("g <> 'z'"), "g", "b")) == []
    wide = frame.withColumn("g", (F.col("k") % 9).cast("string"))
    assert rows(stats.anova_oneway(wide, "g", "b")) == []


def table_of(spark, counts):
    data = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "a string, b string")


def test_chi_square_uses_yates_on_two_by_two(spark):
    df = table_of(spark, {("p", "u"): 10, ("p", "v"): 20, ("q", "u"): 30, ("q", "v"): 15})
    (r,) = rows(stats.chi_square(df, "a", "b"))
    want = 75 * (abs(10 * 15 - 20 * 30) - 37.5) ** 2 / (30 * 45 * 40 * 35)
    assert r["statistic"] == pytest.approx(want) and r["dof"] == 1
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))


def test_chi_square_counts_empty_cells(spark):
    # one empty cell of six leaves 5/6 of the cells filled
    counts = {("p", "u"): 10, ("p", "v"): 20, ("p", "w"): 5, ("q", "u"): 30, ("q", "v"): 15}
    (r,) = rows(stats.chi_square(table_of(spark, counts), "a", "b"))
    grid = np.array([[10, 20, 5], [30, 15, 0]], float)
    expected = grid.sum(1)[:, None] * grid.sum(0)[None] / grid.sum()
    assert r["statistic"] == pytest.approx(((grid - expected) ** 2 / expected).sum()) and r["dof"] == 2
    counts[("p", "w")] = 2
    assert rows(stats.chi_square(table_of(spark, counts), "a", "b")) == []


def test_chi_square_refuses_wide_categories(spark):
    df = spark.range(2000).select((F.col("id") % 11).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    assert rows(stats.chi_square(df, "a", "b")) == []
    many = spark.range(2000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    assert rows(stats.chi_square(many, "a", "b")) == []


def test_all_tests_in_words(frame):
    df = frame.select("a", "b", F.when(F.col("k") % 2 == 0, "on").otherwise("off").alias("s"), "g")
    got = rows(stats.statistical_tests(df, {"s": 2, "g": 3}))
    assert [r["test_name"].split()[0] for r in got] == ["Two-Sample", "One-Way", "Chi-Square"]
    assert got[0]["variables"] == "a across s ('off' vs 'on')" and got[2]["variables"] == "s and g"
    assert all(r["is_significant"] == (r["p_value"] < 0.05) for r in got)


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(5, "a"), (1, "b"), (2, None), (3, "a"), (4, "c")], "k int, v string")
    assert {r.v: r.code for r in stats.factorize(df, "v", "k").collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r.k: r.v for r in stats.with_codes(df, "v", "k").collect()} == {5: 1.0, 1: 0.0, 2: -1.0, 3: 1.0, 4: 2.0}


def test_feature_target_correlation(frame, numbers):
    got = {r.feature: r.correlation for r in stats.feature_target_corr(frame, "b", ["a", "c", "g"], "k").collect()}
    assert got["a"] == pytest.approx(numbers["a"].corr(numbers["b"]))
    assert got["c"] == pytest.approx(numbers["c"].corr(numbers["b"]))
    assert got["g"] == pytest.approx(pd.Series(pd.factorize(numbers["g"])[0]).corr(numbers["b"]))


@pytest.mark.parametrize("column", ["a", "c"])
def test_bins_match_qcut(frame, numbers, column):
    df = numbers[[column, "b"]].dropna()
    bins = min(6, df[column].nunique())
    want = df.groupby(pd.qcut(df[column], bins, duplicates="drop"), observed=True).agg({column: "mean", "b": "mean"})
    got = rows(stats.binned_relationship(frame, column, "b"), "bin")
    assert [r["feature_avg"] for r in got] == pytest.approx(want[column].tolist())
    assert [r["target_avg"] for r in got] == pytest.approx(want["b"].tolist())


def test_groups_without_variation(spark):
    df = spark.range(24).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 3).cast("string").alias("h"), F.lit(1.0).alias("v"))
    (t,) = rows(stats.welch_ttest(df, "g", "v"))
    (f,) = rows(stats.anova_oneway(df, "h", "v"))
    assert t["statistic"] is None and f["statistic"] is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_wide_correlations_equal_numpy(spark, method, monkeypatch):
    """More columns than a tile, offsets far from zero, a constant column, gaps."""
    from tallyloom.operators import gram

    monkeypatch.setattr(gram, "TILE", 7)
    draw = np.random.default_rng(3)
    n, d = 400, 30
    x = draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) + 1e8
    x[:, 3] = 0.1
    x[:, 4] = np.round(x[:, 4] - 1e8)
    x[5, 6] = np.nan
    names = [f"c{i}" for i in range(d)]
    rows = [[None if (i == 9 and j == 2) else float(x[i, j]) for j in range(d)] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    whole = pd.DataFrame(np.delete(x, [5, 9], axis=0), columns=names)
    expected = whole.corr(method)
    got = stats.correlation_pairs(df, names, method).collect()
    assert len(got) == d * (d - 1) // 2
    for r in got:
        assert r.rows == n - 2 and r.i < r.j
        if "c3" in (r.var1, r.var2):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(expected.loc[r.var1, r.var2], abs=1e-6 if method == "pearson" else 1e-12)


def test_five_hundred_columns_take_one_scan(spark):
    names = [f"c{i}" for i in range(500)]
    df = spark.range(300).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(500)])
    pairs = stats.correlation_pairs(df, names)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Range (0, 300") == 1
    x = df.toPandas().to_numpy()
    expected = np.corrcoef(x.T)
    got = pairs.toPandas()
    assert len(got) == 500 * 499 // 2
    assert np.abs(expected[got["i"], got["j"]] - got["correlation"]).max() < 1e-9


def test_pairs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [(r.correlation, r.rows) for r in stats.correlation_pairs(df).collect()] == [(None, 0)]


def test_targets_use_pairwise_known_rows(spark):
    draw = np.random.default_rng(4)
    frame = pd.DataFrame(draw.normal(size=(300, 4)) + 1e7, columns=list("abct"))
    frame["c"] = 0.3
    for column, every in (("a", 3), ("b", 5), ("t", 7)):
        frame.loc[::every, column] = np.nan
    frame.insert(0, "k", range(300))
    df = spark.createDataFrame(frame).repartition(4)
    got = {r.feature: r.correlation for r in stats.feature_target_corr(df, "t", ["a", "b", "c"], "k").collect()}
    expected = frame.corr()["t"]
    assert got == {"a": pytest.approx(expected["a"], abs=1e-9), "b": pytest.approx(expected["b"], abs=1e-9), "c": 0.0}
