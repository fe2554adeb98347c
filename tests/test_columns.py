from __future__ import annotations

from tallyloom.functions import columns


def test_aliases_ignore_case_and_blanks():
    found = columns.match_aliases(["Invoice No", "CustomerID", "Order Date", "Qty", "unit price", "ITEM"])
    assert found == {
        "invoice": "Invoice No",
        "customer": "CustomerID",
        "date": "Order Date",
        "product": "ITEM",
        "quantity": "Qty",
        "price": "unit price",
        "country": None,
    }


def test_missing_fields_do_not_ask_for_country():
    assert columns.missing_fields(["invoice", "customer", "date", "product", "qty"]) == [
        "Missing required column: price"
    ]
    assert columns.missing_fields(["invoice", "customer", "date", "product", "qty", "price"]) == []


def test_find_column_takes_the_first_in_table_order(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], "price_band string, unit_price double, amount int")
    assert columns.find_column(df, ["price", "amount"]) == "price_band"
    assert columns.find_column(df, ["price", "amount"], numeric=True) == "unit_price"
    assert columns.find_column(df, ["price"], numeric=True, exclude=["unit_price"]) is None


def test_measures_leave_out_identifiers(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "x")], "user_id int, zipcode int, spend double, name string")
    assert columns.measure_columns(df) == ["spend"]
    assert columns.clustering_features(df) == ["user_id", "zipcode", "spend"]


def test_names():
    assert columns.display_name("unit_price") == "Unit Price"
