"""Key figures, trends and top-k breakdowns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import numeric_columns
from tallyloom.functions.exprs import as_timestamp, is_missing, known, mean, month_of, percent_change, ratio, total

# Spellings that count as "has left".
LEFT_VALUES = ["yes", "true", "1", "left"]


# --- key figures -----------------------------------------------------------


def prior_window(start: date, end: date) -> tuple[date, date]:
    """The window of equal length that ends the day before ``start``."""
    return start - timedelta(days=(end - start).days + 1), start - timedelta(days=1)


def kpi_summary(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Revenue, order lines, customers and order value of a window, with the change
    against the window before it, and the repeat rate.

    Both windows and the all-time repeat count come from one scan: rows are first
    combined per customer (map-side too), then over customers.
    """
    before_start, before_end = prior_window(start, end)
    now = F.col("order_date").between(F.lit(start), F.lit(end))
    then = F.col("order_date").between(F.lit(before_start), F.lit(before_end))
    amount = known(F.col("total_price"))
    per_customer = orders.groupBy("customer_id").agg(
        F.sum(F.when(now, amount)).alias("now_revenue"),
        F.count_if(now).alias("now_lines"),
        F.sum(F.when(then, amount)).alias("then_revenue"),
        F.count_if(then).alias("then_lines"),
        F.count(F.lit(1)).alias("all_lines"),
    )
    named = F.col("customer_id").isNotNull()
    sums = per_customer.agg(
        total(F.col("now_revenue")).alias("now_revenue"),
        F.coalesce(F.sum("now_lines"), F.lit(0)).alias("now_lines"),
        F.count_if(named & (F.col("now_lines") > 0)).alias("now_customers"),
        total(F.col("then_revenue")).alias("then_revenue"),
        F.coalesce(F.sum("then_lines"), F.lit(0)).alias("then_lines"),
        F.count_if(named & (F.col("then_lines") > 0)).alias("then_customers"),
        F.count_if(F.col("all_lines") > 1).alias("repeaters"),
    ).withColumns(
        {
            "now_aov": ratio(F.col("now_revenue"), F.col("now_lines")),
            "then_aov": ratio(F.col("then_revenue"), F.col("then_lines")),
        }
    )
    return sums.select(
        F.col("now_revenue").alias("total_revenue"),
        F.col("now_lines").alias("order_lines"),
        F.col("now_customers").alias("total_customers"),
        F.col("now_aov").alias("avg_order_value"),
        (F.col("repeaters") * 100.0 / F.greatest("now_customers", F.lit(1))).alias("repeat_customer_rate"),
        percent_change(F.col("now_revenue"), F.col("then_revenue")).alias("revenue_change_pct"),
        percent_change(F.col("now_lines"), F.col("then_lines")).alias("orders_change_pct"),
        percent_change(F.col("now_customers"), F.col("then_customers")).alias("customers_change_pct"),
        percent_change(F.col("now_aov"), F.col("then_aov")).alias("aov_change_pct"),
    )


def repeat_customers(orders: DataFrame) -> DataFrame:
    """Customers with more than one order line, all customers, and their ratio."""
    per_customer = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("lines"))
    repeaters = F.count_if(F.col("lines") > 1)
    return per_customer.agg(
        repeaters.alias("repeat_customers"),
        F.count(F.lit(1)).alias("customers"),
        ratio(repeaters * 100, F.count(F.lit(1))).alias("repeat_rate"),
    )


def commerce_kpis(df: DataFrame, customer: str, invoice: str, amount: str) -> DataFrame:
    """Revenue, distinct orders and customers, order value, share of customers with
    more than one distinct order.

    One scan with two grouping sets replaces three distinct counts.
    """
    pieces = df.groupingSets([[customer, invoice], [invoice]], customer, invoice).agg(
        F.grouping(customer).alias("whole"), F.sum(known(F.col(amount))).alias("amount")
    )
    per_customer = pieces.groupBy("whole", customer).agg(
        F.count(invoice).alias("orders"), F.sum("amount").alias("amount")
    )
    whole = F.col("whole") == 1
    single = ~whole & F.col(customer).isNotNull()
    sums = per_customer.agg(
        total(F.when(whole, F.col("amount"))).alias("total_revenue"),
        F.coalesce(F.sum(F.when(whole, F.col("orders"))), F.lit(0)).alias("total_orders"),
        F.count_if(single).alias("total_customers"),
        F.count_if(single & (F.col("orders") > 1)).alias("repeaters"),
    )
    return sums.select(
        "total_revenue",
        "total_orders",
        "total_customers",
        ratio(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
        ratio(F.col("repeaters") * 100, F.col("total_customers")).alias("repeat_rate"),
    )


def workforce_kpis(df: DataFrame, entity: str, salary: str, tenure: str, attrition: str) -> DataFrame:
    """Head count, mean salary, mean tenure and the percentage that has left."""
    left = F.lower(F.col(attrition).cast("string")).isin(LEFT_VALUES)
    return df.agg(
        F.countDistinct(entity).alias("workforce"),
        mean(F.col(salary)).alias("avg_salary"),
        mean(F.col(tenure)).alias("avg_tenure"),
        ratio(F.count_if(left) * 100, F.count(F.lit(1))).alias("attrition_rate"),
    )


def generic_kpis(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric columns and the percentage of missing cells (null or NaN)."""
    width = len(df.columns)
    empty = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("records"),
        F.lit(width).alias("features"),
        F.lit(len(numeric_columns(df))).alias("numeric_features"),
        ratio(empty * 100, rows * width).alias("missing_pct"),
    )


def sales_summary(df: DataFrame, amount: str) -> DataFrame:
    """Total revenue, order lines and revenue per line."""
    lines = F.count(F.lit(1))
    return df.agg(
        total(F.col(amount)).alias("total_revenue"),
        lines.alias("order_lines"),
        ratio(total(F.col(amount)), lines).alias("avg_order_value"),
    )


# --- trends ----------------------------------------------------------------


def _by_month(df: DataFrame, when: str, amount: str) -> DataFrame:
    rows = df.select(as_timestamp(df, when).alias("at"), F.col(amount).alias("amount")).dropna()
    return rows.groupBy(month_of(F.col("at")).alias("month"))


def revenue_trend(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Revenue and order lines per month inside a date range."""
    return (
        orders.where(F.col("order_date").between(F.lit(start), F.lit(end)))
        .groupBy(F.trunc("order_date", "month").alias("month_start"))
        .agg(total(F.col("total_price")).alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .withColumn("month", F.date_format("month_start", "yyyy-MM"))
        .orderBy("month_start")
    )


def trend_last(df: DataFrame, when: str, amount: str, periods: int = 12) -> DataFrame:
    """Sum and row count of the latest months that have data."""
    months = _by_month(df, when, amount).agg(
        total(F.col("amount")).alias("revenue"), F.count(F.lit(1)).alias("orders")
    )
    return months.orderBy(F.desc("month")).limit(periods).orderBy("month")


def chart_trend(df: DataFrame, when: str, amount: str, periods: int = 12) -> DataFrame:
    """Sum and mean of the earliest months, for the trend chart."""
    months = _by_month(df, when, amount).agg(
        total(F.col("amount")).alias("total"), mean(F.col("amount")).alias("average")
    )
    return months.orderBy("month").limit(periods)


def monthly_sales(df: DataFrame, when: str, amount: str) -> DataFrame:
    """Revenue, order lines, order value and growth on the month before.

    The window runs over finished months, one row each.
    """
    months = _by_month(df, when, amount).agg(
        total(F.col("amount")).alias("revenue"), F.count(F.lit(1)).alias("orders")
    )
    prior = F.lag("revenue").over(W.orderBy("month"))
    return months.withColumns(
        {
            "avg_order_value": ratio(F.col("revenue"), F.col("orders")),
            "growth_pct": F.when(prior > 0, (F.col("revenue") - prior) / prior * 100),
        }
    )


def monthly_gapfilled(df: DataFrame, when: str, amount: str) -> DataFrame:
    """Monthly sums with empty months as 0, and the change on the month before."""
    months = (
        df.select(as_timestamp(df, when).alias("at"), F.col(amount).alias("amount"))
        .dropna()
        .groupBy(F.trunc("at", "month").alias("month_start"))
        .agg(total(F.col("amount")).alias("sum"))
    )
    spine = months.agg(F.min("month_start").alias("first"), F.max("month_start").alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month_start")
    )
    prior = F.lag("total").over(W.orderBy("month_start"))
    return (
        spine.join(months, "month_start", "left")
        .select("month_start", F.coalesce("sum", F.lit(0.0)).alias("total"))
        .withColumn("change_pct", F.when(prior > 0, (F.col("total") - prior) / prior * 100))
    )


# --- breakdowns ------------------------------------------------------------


def top_by_amount(
    df: DataFrame, by: str, amount: str, k: int, label: str | None = None, label_length: int | None = None
) -> DataFrame:
    """The k groups with the largest sums, ties by name: (label, revenue, orders)."""
    label = label or by
    top = (
        df.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias(label))
        .agg(total(F.col(amount)).alias("revenue"), F.count(known(F.col(amount))).alias("orders"))
        .orderBy(F.desc("revenue"), label)
        .limit(k)
    )
    if label_length:
        top = top.withColumn(label, F.substring(F.col(label).cast("string"), 1, label_length))
    return top


def country_revenue(orders: DataFrame, k: int = 10) -> DataFrame:
    return top_by_amount(orders, "country", "total_price", k)


def top_products(orders: DataFrame, k: int = 10) -> DataFrame:
    """Products by revenue, with the quantity sold."""
    return (
        orders.groupBy("product")
        .agg(total(F.col("total_price")).alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity"))
        .orderBy(F.desc("revenue"), "product")
        .limit(k)
    )


def value_shares(df: DataFrame, by: str, k: int, of_rows: bool = True) -> DataFrame:
    """Most frequent values with their percentage of all rows (or of non-null rows)."""
    everything = df.agg(F.count(F.lit(1) if of_rows else F.col(by))).scalar()
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "label")
        .limit(k)
        .withColumn("percentage", F.col("count") * 100.0 / everything)
    )


def category_share(df: DataFrame, by: str) -> DataFrame:
    return value_shares(df, by, 5)


def chart_category(df: DataFrame, by: str) -> DataFrame:
    return value_shares(df, by, 8).drop("percentage")


def segment_distribution(segments: DataFrame, rfm: DataFrame) -> DataFrame:
    """Customers, share and spend per segment; customers without scores count too. The
    total is taken over the finished segments, a handful of rows."""
    everyone = F.sum("customers").over(W.partitionBy())
    return (
        segments.join(rfm.select("customer_id", "monetary"), "customer_id", "left")
        .groupBy("segment_label")
        .agg(F.count(F.lit(1)).alias("customers"), total(F.col("monetary")).alias("revenue"))
        .withColumn("percentage", F.col("customers") * 100.0 / everyone)
    )


def histogram(df: DataFrame, column: str, max_bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins count 0."""
    values = df.select(F.col(column).cast("double").alias("v")).dropna()
    distinct = values.distinct().limit(max_bins).agg(F.count(F.lit(1)).cast("int")).scalar()
    limits = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    low, high = limits["low"], limits["high"]
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    end = F.when(flat, high + 0.5).otherwise(high)

    def bin_of(value: Column) -> Column:
        place = F.floor((value - start) / (end - start) * distinct).cast("int")
        return F.least(place, distinct - 1)

    filled = values.groupBy(bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(max_bins).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.where(F.col("bin") < distinct)
        .join(filled, "bin", "left")
        .select(
            "bin",
            (start + F.col("bin") * ((end - start) / distinct)).alias("bin_start"),
            F.coalesce("n", F.lit(0)).alias("frequency"),
        )
    )
