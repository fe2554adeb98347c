from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import rows

from tallyloom.operators import dashboard


@pytest.fixture(scope="module")
def orders(spark):
    d = dt.date
    return spark.createDataFrame(
        [
            (1, "i1", d(2025, 1, 5), 10.0, "A"),
            (1, "i2", d(2025, 2, 5), 30.0, "A"),
            (2, "i3", d(2025, 2, 6), 20.0, "B"),
            (3, "i4", d(2025, 4, 1), 5.0, None),
        ],
        "customer_id int, invoice_id string, order_date date, total_price double, country string",
    )


def test_prior_window():
    assert dashboard.prior_window(dt.date(2025, 2, 1), dt.date(2025, 2, 28)) == (dt.date(2025, 1, 4), dt.date(2025, 1, 31))


def test_kpis_against_the_window_before(orders):
    (k,) = rows(dashboard.kpi_summary(orders, dt.date(2025, 2, 1), dt.date(2025, 2, 28)))
    assert k["total_revenue"] == 50.0 and k["order_lines"] == 2 and k["total_customers"] == 2
    assert k["revenue_change_pct"] == 400.0 and k["orders_change_pct"] == 100.0
    assert k["repeat_customer_rate"] == 50.0


def test_empty_windows_give_zero(orders):
    (k,) = rows(dashboard.kpi_summary(orders, dt.date(2020, 2, 1), dt.date(2020, 2, 28)))
    assert k["total_revenue"] == 0.0 and k["avg_order_value"] == 0.0 and k["revenue_change_pct"] == 0.0
    assert k["repeat_customer_rate"] == 100.0  # one repeater over at least one customer


def test_commerce_kpis_skip_null_keys(spark):
    df = spark.createDataFrame(
        [("a", "1", 5.0), ("a", "2", 5.0), ("b", "2", 1.0), (None, "3", 2.0), ("b", None, 4.0)],
        "c string, i string, v double",
    )
    (k,) = rows(dashboard.commerce_kpis(df, "c", "i", "v"))
    assert k == {
        "total_revenue": 17.0,
        "total_orders": 3,
        "total_customers": 2,
        "avg_order_value": pytest.approx(17 / 3),
        "repeat_rate": 50.0,
    }


def test_workforce_counts_nulls_as_present(spark):
    df = spark.createDataFrame(
        [("e1", 10.0, 1, "Yes"), ("e2", 20.0, 3, "no"), ("e2", None, 2, None), ("e3", 30.0, 2, "LEFT")],
        "id string, salary double, tenure int, attrition string",
    )
    (k,) = rows(dashboard.workforce_kpis(df, "id", "salary", "tenure", "attrition"))
    assert k == {"workforce": 3, "avg_salary": 20.0, "avg_tenure": 2.0, "attrition_rate": 50.0}


def test_generic_kpis(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    (k,) = rows(dashboard.generic_kpis(df))
    assert k == {"records": 2, "features": 2, "numeric_features": 1, "missing_pct": 25.0}


def test_gaps_are_filled(orders):
    got = rows(dashboard.monthly_gapfilled(orders, "order_date", "total_price"), "month_start")
    assert [r["total"] for r in got] == [10.0, 50.0, 0.0, 5.0]
    assert [r["change_pct"] for r in got] == [None, 400.0, -100.0, None]


def test_monthly_sales_has_no_gaps_to_fill(orders):
    got = rows(dashboard.monthly_sales(orders, "order_date", "total_price"), "month")
    assert [r["month"] for r in got] == ["2025-01", "2025-02", "2025-04"]
    assert got[2]["growth_pct"] == -90.0 and got[1]["avg_order_value"] == 25.0


def test_first_and_last_periods(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}-15", float(m)) for m in range(1, 13)] + [("2025-01-15", 13.0), ("junk", 1.0)], "d string, v double")
    assert [r["month"] for r in rows(dashboard.trend_last(df, "d", "v"), "month")][0] == "2024-02"
    assert [r["month"] for r in rows(dashboard.chart_trend(df, "d", "v"), "month")][-1] == "2024-12"


def test_ties_go_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), (None, 9.0)], "k string, v double")
    assert [r["k"] for r in dashboard.top_by_amount(df, "k", "v", 2).collect()] == ["c", "a"]


def test_shares_of_rows_and_of_known_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(dashboard.value_shares(df, "k", 1))[0]["percentage"] == 50.0
    assert rows(dashboard.value_shares(df, "k", 1, of_rows=False))[0]["percentage"] == pytest.approx(200 / 3)


def test_segments_without_scores_count(spark):
    segments = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "customer_id int, segment_label string")
    scores = spark.createDataFrame([(1, 5.0)], "customer_id int, monetary double")
    got = rows(dashboard.segment_distribution(segments, scores), "segment_label")
    assert [(r["customers"], r["revenue"]) for r in got] == [(2, 5.0), (1, 0.0)]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 10.0, 10.0], [3.0, 3.0], (np.linspace(0, 7, 40) ** 2).tolist()])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    counts, edges = np.histogram(values, bins=min(10, len(set(values))))
    got = rows(dashboard.histogram(df, "v"), "bin")
    assert [r["frequency"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())
