from __future__ import annotations

from conftest import rows

from tallyloom.plans import dashboards


def sections(df):
    out = {}
    for r in rows(df):
        out.setdefault(r["section"], []).append((r["label"], r["value"], r["rows"]))
    return out


def test_commerce_table(spark):
    data = [("i1", "c1", "2025-01-05", 10.0, "mug", "FR"), ("i2", "c1", "2025-02-05", 5.0, "cup", "DE"), ("i3", "c2", "2025-02-07", float("nan"), "pot", "FR")]
    df = spark.createDataFrame(data, "invoice_no string, customer_id string, sold_date string, amount double, product string, country string")
    roles = dashboards.column_roles(df, {"product": 3, "country": 2})
    assert (roles.revenue, roles.customer, roles.invoice, roles.when) == ("amount", "customer_id", "invoice_no", "sold_date")
    assert (roles.measure, roles.item, roles.place) == ("amount", "product", "country")
    got = sections(dashboards.table_dashboard(df, {"product": 3, "country": 2}, "sales"))
    assert {k: v for k, v, _ in got["kpi"]} == {"Total Revenue": 15.0, "Total Orders": 3.0, "Active Customers": 2.0, "Repeat Rate": 50.0}
    assert sorted(got["places"]) == [("DE", 5.0, 1), ("FR", 10.0, 1)]
    assert len(got["items"]) == len(got["shares"]) == 3
    page = sections(dashboards.sales_page(df))
    assert page["total"] == [("revenue", 15.0, 3)] and sorted(page["products"])[0][0] == "cup"


def test_distinct_counts_rule_columns_out(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "label string, region string, spend double")
    roles = dashboards.column_roles(df, {"label": 2, "region": 201})
    assert roles.item is None and roles.place is None and roles.when is None
    assert set(sections(dashboards.table_dashboard(df, {"label": 2, "region": 201}, "other"))) == {"kpi"}


def test_workforce_without_its_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "nickname string")
    got = {k: v for k, v, _ in sections(dashboards.table_dashboard(df, {}, "hr"))["kpi"]}
    assert got == {"Total Workforce": 2.0, "Average Salary": 0.0, "Average Tenure": 0.0, "Attrition Rate": 0.0}
    assert dashboards.sales_page(df).count() == 0


def test_directory_of_any_table(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], "row int, team string, total_words string")
    got = rows(dashboards.any_directory(df, "row", "team"), "customer_code")
    assert [(r["customer_code"], r["total_orders"], r["total_revenue"], r["country"]) for r in got] == [("a", 2, 0.0, "Global"), ("b", 1, 0.0, "Global")]
