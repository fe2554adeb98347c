from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import directory, rfm


@pytest.fixture(scope="module")
def parts(spark):
    d = dt.date
    customers = spark.createDataFrame(
        [(1, "C1", "Ann", "Spain"), (2, "C2", "Bob", "France"), (3, "C3", "Cy", "spain")],
        "customer_id int, customer_code string, name string, country string",
    )
    orders = spark.createDataFrame(
        [(1, "i1", d(2025, 1, 1), 5.0, "a"), (1, "i2", d(2025, 1, 3), 7.0, "b"), (2, "i3", d(2025, 1, 2), 20.0, "c")],
        "customer_id int, invoice_id string, order_date date, total_price double, line_id string",
    )
    scores = rfm.rfm_asof(customers, orders, d(2025, 1, 10))
    return customers, orders, scores, rfm.rfm_segments(scores)


def test_directory_keeps_customers_without_orders(parts):
    got = {r["customer_id"]: r for r in rows(directory.customer_directory(*parts))}
    assert got[3]["total_orders"] == 0 and got[3]["total_revenue"] == 0.0 and got[3]["segment_label"] is None
    assert got[1]["total_orders"] == 2 and got[1]["last_purchase_date"] == dt.date(2025, 1, 3)


def test_filters_ignore_case(parts):
    whole = directory.customer_directory(*parts)
    assert {r["customer_id"] for r in rows(directory.filter_directory(whole, country="SPAIN"))} == {1, 3}
    assert {r["customer_id"] for r in rows(directory.filter_directory(whole, term="c2"))} == {2}
    assert rows(directory.filter_directory(whole, segment="nobody")) == []


def test_pages(parts):
    whole = directory.customer_directory(*parts)
    first = directory.sort_page(whole, "customer_id", "total_revenue", page=1, page_size=2).collect()
    assert [r.customer_id for r in first] == [2, 1]
    second = directory.sort_page(whole, "customer_id", "no such column", page=2, page_size=2).collect()
    assert [r.customer_id for r in second] == [3]
    assert rows(directory.page_counts(whole, 2)) == [{"total": 3, "total_pages": 2}]
    assert rows(directory.page_counts(whole.where("false"), 2)) == [{"total": 0, "total_pages": 1}]


def test_detail(parts):
    (one,) = rows(directory.customer_detail(1, *parts))
    assert one["avg_order_value"] == 6.0
    assert [o["invoice_id"] for o in one["orders"]] == ["i2", "i1"]
    (none,) = rows(directory.customer_detail(3, *parts))
    assert none["recommended_actions"] == directory.DEFAULT_PLAY


def test_recent_orders_stop_at_k(parts):
    assert {r["invoice_id"] for r in rows(directory.recent_orders(parts[1], 1))} == {"i2", "i3"}


def test_latest_prefers_the_active_row(spark):
    df = spark.createDataFrame(
        [("w", 1, True, 1), ("w", 2, False, 9), ("v", 3, False, 4), ("v", 4, False, 5)],
        "w string, k int, active boolean, at int",
    )
    got = {r["w"]: r["k"] for r in rows(directory.latest_per_group(df, "w", "active", "at", "k"))}
    assert got == {"w": 1, "v": 4}


def test_entities_take_the_first_known_place(spark):
    df = spark.createDataFrame(
        [("e", 2, 1.0, "late"), ("e", 1, 2.0, None), (None, 3, 4.0, "x")], "e string, k int, v double, c string"
    )
    assert rows(directory.entity_directory(df, "e", "k", "v", "c")) == [
        {"customer_code": "e", "total_orders": 2, "total_revenue": 3.0, "country": "late"}
    ]
    assert rows(directory.entity_directory(df, "e", "k", None, None))[0]["country"] == "Global"


def test_entity_summary(spark):
    df = spark.createDataFrame(
        [(7, 2, 1.0, None, "2025-01-02"), (7, 1, 2.0, "A", "2025-01-09"), (8, 3, 4.0, "x", None)],
        "e int, k int, v double, c string, d string",
    )
    (one,) = rows(directory.entity_summary(df, "e", "7", "k", "v", "c", "d"))
    assert one["total_orders"] == 2 and one["country"] == "A" and one["last_activity"] == dt.datetime(2025, 1, 9)
    assert one["attributes"] == {"e": "7", "k": "1", "v": "2.0", "c": "A", "d": "2025-01-09"}
    assert [r.k for r in directory.entity_records(df, "e", "7", "k", 1).collect()] == [1]
    assert rows(directory.entity_summary(df, "e", "99", "k", "v", "c", "d")) == []


def test_actions(spark):
    df = spark.createDataFrame([(rfm.VIP,), ("?",), (None,)], "s string").select("s", directory.segment_actions(F.col("s")).alias("a"))
    got = {r.s: r.a for r in df.collect()}
    assert got[rfm.VIP][0] == "Offer exclusive loyalty rewards" and got["?"] == got[None] == directory.DEFAULT_PLAY


def test_entity_key_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id % 7 AS string) AS name", "cast(id AS decimal(10,2)) AS price").write.parquet(path)
    df = spark.read.parquet(path)
    plan = directory.entity_records(df, "id", "7", "id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan
    for column, value, found in [("id", "7", 1), ("id", "07", 0), ("id", "x", 0), ("name", "3", 14), ("price", "7.00", 1), ("price", "7", 0)]:
        assert len(directory.entity_records(df, column, value, "id", 50).collect()) == found, (column, value)
