from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import ranking


def hot_values(n=900, seed=3):
    """A third of the rows share one value."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 200, n).astype(float)
    values[: n // 3] = 77.0
    return pd.DataFrame({"k": rng.permutation(n), "v": values})


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_values()).repartition(7)


@pytest.mark.parametrize("parts", [1, 5])
def test_global_rank_with_a_hot_value(spark, hot, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
    try:
        ranked = ranking.global_rank(hot, "v", ["k"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = hot_values().sort_values(["v", "k"]).reset_index(drop=True)
    expected["rank"] = np.arange(1, len(expected) + 1)
    got = ranked.sort_values("rank").reset_index(drop=True)
    assert (got["k"] == expected["k"]).all() and (got["n"] == 900).all()


def test_hot_value_is_spread_over_partitions(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = ranking._spread(hot, ["v", "k"], "test")
        sizes = [r["count"] for r in stored.groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)


def test_groups_and_descending(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 5, 2), ("b", 9, 3), ("a", 5, 4)], "g string, v int, k int")
    got = {(r.g, r.k): (r.rank, r.n) for r in ranking.global_rank(df, "v", ["k"], ["g"], descending=True).collect()}
    assert got == {("a", 2): (1, 3), ("a", 4): (2, 3), ("a", 1): (3, 3), ("b", 3): (1, 1)}


def test_running_counts(hot):
    counts = ranking.value_counts(hot, [], "v")
    got = ranking.running_counts(counts, [], "v").toPandas().set_index("v")
    values = hot_values()["v"]
    for v in (0.0, 77.0, 199.0):
        assert got.loc[v, "below"] == (values < v).sum() and got.loc[v, "rows"] == (values == v).sum()
    assert (got["n"] == 900).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles(spark, seed):
    data = hot_values(100 + seed, seed)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    counts = ranking.value_counts(spark.createDataFrame(data), [], "v")
    got = {r.probability: r.quantile for r in ranking.exact_quantiles(counts, [], "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(data["v"], p))


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_quantiles_sort_only_the_bins_they_lie_in(spark, monkeypatch, bits):
    """Whole partitions were shuffled and sorted, of which a value or two was wanted."""
    monkeypatch.setattr(ranking, "BIN_BITS", bits)
    data = hot_values(300, 4).assign(g=lambda d: np.where(d["k"] % 3 == 0, "a", "b"))
    counts = ranking.value_counts(spark.createDataFrame(data), ["g"], "v")
    found = ranking.exact_quantiles(counts, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    sums = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "_place" in line]
    assert sums and all("_bin" in line for line in sums)
    for r in found.collect():
        of = data[data["g"] == r.g]["v"]
        assert r.quantile == pytest.approx(np.quantile(of, r.probability)) and r.n == len(of)


@pytest.mark.parametrize("n", [5, 6, 11, 23, 100])
def test_quintile_by_rank_matches_qcut(spark, n):
    got = spark.range(1, n + 1).select("id", ranking.quintile_by_rank(F.col("id"), F.lit(n)).alias("q")).toPandas()
    assert (got["q"] == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).all()


def test_quintile_of_one_row(spark):
    (row,) = spark.range(1).select(ranking.quintile_by_rank(F.lit(1), F.lit(1)).alias("q")).collect()
    assert row.q == 1


def test_rows_below_gives_average_ranks(hot):
    placed = ranking.rows_below(hot, ["v"]).toPandas()
    average = placed["v_below"] + (placed["v_ties"] + 1) / 2
    assert average.tolist() == pytest.approx(placed["v"].rank().tolist())


def test_no_single_task_sort(hot):
    plan = ranking.global_rank(hot, "v", ["k"])._jdf.queryExecution().explainString(
        hot.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    # Only the list of per-partition totals may meet in one place.
    assert plan.count("SinglePartition") <= 2 and "CartesianProduct" not in plan
