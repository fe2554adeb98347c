from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows

from tallyloom.operators import cleaning

RAW = "InvoiceNo string, Description string, Quantity string, InvoiceDate string, UnitPrice string, CustomerID string, Country string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [
            ("1", " Mug ", "2", "2025-03-01 10:00:00", "10.5", " 1001 ", None),
            ("2", None, "3", "2025/03/02", "2", "1002", " France "),
            ("C3", "Mug", "-2", "2025-03-03", "10.5", "1001", "Spain"),
            ("4", "Mug", "1", "2025-03-03", "0", "1001", "Spain"),
            ("5", "Mug", "1", "soon", "1", "1001", "Spain"),
            ("6", "Mug", "1", "2025-03-03", "1", None, "Spain"),
            ("7", "Mug", "many", "2025-03-03", "1", "1003", "Spain"),
            ("8", "Mug", "1", "2025-03-03", "1", "nan", "Spain"),
            ("9", "Mug", None, "soon", "1", "1003", "Spain"),
            ("10", "Mug", "1", "12/1/2010 8:26", "1", "1004", "Spain"),
        ],
        RAW,
    )


def test_good_rows_stay(raw):
    clean = rows(cleaning.clean_transactions(raw), "invoice")
    assert [r["invoice"] for r in clean] == ["1", "10", "2"]
    first = clean[0]
    assert first["customer"] == "1001" and first["product"] == "Mug" and first["country"] == "Unknown"
    assert first["total_price"] == 21.0
    assert clean[1]["date"] == dt.datetime(2010, 12, 1, 8, 26)
    assert clean[2]["product"] == "Unknown" and clean[2]["country"] == "France"


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame(
        [("1", "a", "2025-01-01", 1.0, 2.0, "p"), ("2", "a", "2025-01-01", 1.0, float("nan"), "p"), ("3", "a", "2025-01-01", float("nan"), 2.0, "p")],
        "invoice string, customer string, date string, qty double, price double, item string",
    )
    for frame in (df, df.withColumns({"price": df.price.cast("string"), "qty": df.qty.cast("string")})):
        assert [r["invoice"] for r in rows(cleaning.clean_transactions(frame), "invoice")] == ["1"]
        (stats,) = rows(cleaning.clean_stats(frame))
        assert stats["missing_rows"] == 2 and stats["clean_rows"] == 1


def test_each_row_is_counted_under_its_first_cause(raw):
    (stats,) = rows(cleaning.clean_stats(raw))
    assert stats["original_rows"] == 10 and stats["clean_rows"] == 3 and stats["dropped_rows"] == 7
    assert (stats["missing_rows"], stats["bad_date_rows"], stats["not_positive_rows"]) == (2, 1, 3)
    assert stats["issues"][0] == "Dropped 2 rows with missing values"


def test_columns_without_data(spark):
    df = spark.createDataFrame(
        [("a", "x", "2025-01-01", 1, 2.0, "p"), (None, "y", "2025-01-01", 1, 2.0, "p")],
        "invoice string, customer string, date string, qty int, price double, item string",
    ).withColumn("line", __import__("pyspark").sql.functions.lit(7))
    clean = rows(cleaning.clean_transactions(df, "line"), "customer")
    assert [r["invoice"] for r in clean] == ["a", "7"]
    assert {r["country"] for r in clean} == {"Unknown"}


def test_missing_column_is_refused(spark):
    df = spark.createDataFrame([(1,)], "customer int")
    with pytest.raises(ValueError, match="Missing required column: invoice"):
        cleaning.clean_transactions(df)


def test_orders_table_names(raw):
    assert cleaning.orders_table(cleaning.clean_transactions(raw)).columns == [
        "invoice_id", "customer_code", "order_date", "product", "quantity", "price", "total_price", "country",
    ]
