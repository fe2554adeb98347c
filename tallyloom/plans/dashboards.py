"""Dashboard, sales page and entity directory of a table whose columns are not known beforehand.

The columns are chosen by keywords in their names, their types, and the distinct counts of the table's profile; the
figures then come from the operators.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import columns as names
from tallyloom.functions.columns import find_column, is_numeric, is_temporal, measure_columns
from tallyloom.functions.exprs import mean, ratio, total
from tallyloom.operators import dashboard
from tallyloom.operators.directory import entity_directory

# The domains with key figures of their own, and the titles of the figures.
COMMERCE, WORKFORCE = ("ecommerce", "sales"), ("hr",)
COMMERCE_TITLES = ["Total Revenue", "Total Orders", "Active Customers", "Repeat Rate"]
WORKFORCE_TITLES = ["Total Workforce", "Average Salary", "Average Tenure", "Attrition Rate"]
GENERIC_TITLES = ["Total Records", "Total Features", "Numeric Variables", "Missing Cells"]

#: Values of a column of items, and of a column of places: fewer or more make no chart.
ITEM_VALUES, PLACE_VALUES = (3, 200), 50


@dataclass
class Roles:
    """Which column plays which part; None where there is none."""

    revenue: str | None = None
    customer: str | None = None
    invoice: str | None = None
    when: str | None = None
    measure: str | None = None
    item: str | None = None
    place: str | None = None
    worker: str | None = None
    salary: str | None = None
    tenure: str | None = None
    left: str | None = None


def column_roles(df: DataFrame, distinct: Mapping[str, int]) -> Roles:
    """The first column, in table order, that fits each part; ``distinct`` is the profile's count of values by column."""

    def holds(name: str | None, low: int, high: int) -> bool:
        return name is not None and low <= distinct.get(name, 0) <= high

    words = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and "id" not in f.name.lower()]
    dated = [f.name for f in df.schema.fields if is_temporal(f.dataType) or any(w in f.name.lower() for w in names.DATE_KEYWORDS)]
    few = [f.name for f in df.schema.fields if not holds(f.name, 0, PLACE_VALUES)]
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]

    def number(keywords: list[str]) -> str | None:
        found = find_column(df, keywords)
        return found if found in numbers else None

    return Roles(
        revenue=find_column(df, names.REVENUE_KEYWORDS, numeric=True),
        customer=find_column(df, names.CUSTOMER_KEYWORDS),
        invoice=find_column(df, names.INVOICE_KEYWORDS),
        when=next(iter(dated), None),
        measure=next(iter(measure_columns(df)), None),
        item=next((w for w in words if holds(w, *ITEM_VALUES)), None),
        place=find_column(df, names.BREAKDOWN_KEYWORDS, exclude=few),
        worker=find_column(df, names.WORKER_KEYWORDS),
        salary=number(names.SALARY_KEYWORDS),
        tenure=number(names.TENURE_KEYWORDS),
        left=find_column(df, names.ATTRITION_KEYWORDS),
    )


def _section(df: DataFrame, section: str, label: Column, value: Column, rows: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        label.cast("string").alias("label"),
        value.cast("double").alias("value"),
        (F.lit(None) if rows is None else rows).cast("bigint").alias("rows"),
    )


def _figures(one: DataFrame, titles: list[str]) -> DataFrame:
    """A row of figures as a row for each title."""
    values = [F.struct(F.lit(t).alias("label"), F.col(c).cast("double").alias("value")) for t, c in zip(titles, one.columns)]
    long = one.select(F.inline(F.array(*values)))
    return _section(long, "kpi", F.col("label"), F.col("value"))


def key_figures(df: DataFrame, roles: Roles, domain: str) -> DataFrame:
    """The domain's four figures; a part that no column plays counts rows, or is zero."""
    rows, zero = F.count(F.lit(1)), F.lit(0.0)

    def entities(column: str | None) -> Column:
        return F.countDistinct(column) if column else rows

    if domain in COMMERCE:
        if roles.revenue and roles.customer and roles.invoice:
            whole = dashboard.commerce_kpis(df, roles.customer, roles.invoice, roles.revenue)
            return _figures(whole.select("total_revenue", "total_orders", "total_customers", "repeat_rate"), COMMERCE_TITLES)
        found = df.agg(
            (total(F.col(roles.revenue)) if roles.revenue else zero).alias("revenue"),
            entities(roles.invoice).alias("orders"),
            entities(roles.customer).alias("customers"),
        )
        if roles.customer and roles.invoice:
            each = df.where(F.col(roles.customer).isNotNull()).groupBy(roles.customer).agg(F.countDistinct(roles.invoice).alias("n"))
            repeat = each.agg(ratio(F.count_if(F.col("n") > 1) * 100, rows)).scalar()
        else:
            repeat = zero
        return _figures(found.withColumn("repeat", repeat), COMMERCE_TITLES)
    if domain in WORKFORCE:
        left = F.lower(F.col(roles.left).cast("string")).isin(dashboard.LEFT_VALUES) if roles.left else None
        found = df.agg(
            entities(roles.worker).alias("workforce"),
            (F.coalesce(mean(F.col(roles.salary)), zero) if roles.salary else zero).alias("salary"),
            (F.coalesce(mean(F.col(roles.tenure)), zero) if roles.tenure else zero).alias("tenure"),
            (ratio(F.count_if(left) * 100, rows) if roles.left else zero).alias("left"),
        )
        return _figures(found, WORKFORCE_TITLES)
    return _figures(dashboard.generic_kpis(df), GENERIC_TITLES)


def table_dashboard(df: DataFrame, distinct: Mapping[str, int], domain: str) -> DataFrame:
    """(section, label, value, rows): key figures, the last twelve months, the eight largest items and places by the first
    measure, and the shares of the five most frequent items. A section without its columns is left out."""
    roles = column_roles(df, distinct)
    parts = [key_figures(df, roles, domain)]
    if roles.when and roles.measure:
        months = dashboard.trend_last(df, roles.when, roles.measure)
        parts.append(_section(months, "trend", F.col("month"), F.col("revenue"), F.col("orders")))
    for section, by in (("items", roles.item), ("places", roles.place)):
        if by and roles.measure:
            top = dashboard.top_by_amount(df, by, roles.measure, 8, "label", 30 if section == "items" else None)
            parts.append(_section(top, section, F.col("label"), F.col("revenue"), F.col("orders")))
    if roles.item:
        shares = dashboard.category_share(df, roles.item)
        parts.append(_section(shares, "shares", F.col("label"), F.col("percentage"), F.col("count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sales_page(df: DataFrame, revenue: str | None = None, when: str | None = None) -> DataFrame:
    """(section, label, value, rows): totals, months with their order value, the ten largest products and places. The
    revenue and date columns come from the table's plan where it has them."""
    revenue = revenue or find_column(df, names.REVENUE_KEYWORDS, numeric=True)
    if revenue is None:
        return _section(df.limit(0), "total", F.lit(None), F.lit(None))
    when = when or find_column(df, names.DATE_KEYWORDS[:1])
    whole = dashboard.sales_summary(df, revenue)
    parts = [_section(whole, "total", F.lit("revenue"), F.col("total_revenue"), F.col("order_lines"))]
    if when:
        months = dashboard.monthly_sales(df, when, revenue)
        parts.append(_section(months, "monthly", F.col("month"), F.col("revenue"), F.col("orders")))
    for section, keywords, length in (("products", names.PRODUCT_KEYWORDS, 35), ("places", names.PLACE_KEYWORDS, None)):
        by = find_column(df, keywords)
        if by:
            top = dashboard.top_by_amount(df, by, revenue, 10, "label", length)
            parts.append(_section(top, section, F.col("label"), F.col("revenue"), F.col("orders")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def any_directory(df: DataFrame, row_key: str, entity: str | None = None) -> DataFrame:
    """The entities of a table with rows, amount and place; the first column where no entity is named."""
    entity = entity or df.columns[0]
    amount = find_column(df, names.ENTITY_REVENUE_KEYWORDS)
    if amount == entity or (amount and not is_numeric(df.schema[amount].dataType)):
        amount = None
    place = find_column(df, names.ENTITY_PLACE_KEYWORDS)
    return entity_directory(df, entity, row_key, amount, None if place == entity else place)
