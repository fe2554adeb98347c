"""Cleaning of raw transaction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import missing_fields, standardise
from tallyloom.functions.exprs import as_number, as_timestamp, is_missing

KEY_FIELDS = ["customer", "date", "quantity", "price"]
UNKNOWN = "Unknown"

# Why a row is dropped, in the order the rules apply.
MISSING, BAD_DATE, NOT_POSITIVE, NO_CUSTOMER = "missing", "bad_date", "not_positive", "no_customer"


def _text_or_unknown(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(UNKNOWN)
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(UNKNOWN))


def tag_rows(raw: DataFrame, row_key: str | None = None) -> DataFrame:
    """Standardise names and types and name the first rule each row breaks.

    ``drop_reason`` is null for good rows, so the clean table and the statistics
    come from one expression over one scan.
    """
    problems = missing_fields(raw.columns)
    if problems:
        raise ValueError("; ".join(problems))
    df = standardise(raw)

    absent = F.lit(False)
    for name in KEY_FIELDS:
        absent = absent | is_missing(df, name)
    for name in ("quantity", "price"):
        if df.schema[name].dataType.simpleString() == "string":
            absent = absent | F.coalesce(F.isnan(F.trim(F.col(name)).try_cast("double")), F.lit(False))
    date = as_timestamp(df, "date")
    quantity = F.coalesce(as_number(df, "quantity"), F.lit(0))
    price = F.coalesce(as_number(df, "price"), F.lit(0))
    customer = F.trim(F.col("customer").cast("string"))
    reason = (
        F.when(absent, MISSING)
        .when(date.isNull(), BAD_DATE)
        .when(~((quantity > 0) & (price > 0)), NOT_POSITIVE)
        .when(customer == "nan", NO_CUSTOMER)
    )
    row_number = F.col(row_key) if row_key else F.monotonically_increasing_id()
    invoice = F.trim(F.coalesce(F.col("invoice").cast("string"), row_number.cast("string")))
    return df.select(
        invoice.alias("invoice"),
        customer.alias("customer"),
        date.alias("date"),
        _text_or_unknown(df, "product").alias("product"),
        quantity.alias("quantity"),
        price.alias("price"),
        (quantity * price).alias("total_price"),
        _text_or_unknown(df, "country").alias("country"),
        reason.alias("drop_reason"),
    )


def clean_transactions(raw: DataFrame, row_key: str | None = None) -> DataFrame:
    """The usable transaction rows under standard names and types."""
    return tag_rows(raw, row_key).where(F.col("drop_reason").isNull()).drop("drop_reason")


def clean_stats(raw: DataFrame, row_key: str | None = None) -> DataFrame:
    """One row: how many rows came in, were dropped for each cause, and stayed."""
    reason = F.col("drop_reason")
    counts = tag_rows(raw, row_key).agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(reason == MISSING).alias("missing_rows"),
        F.count_if(reason == BAD_DATE).alias("bad_date_rows"),
        F.count_if(reason == NOT_POSITIVE).alias("not_positive_rows"),
        F.count(reason).alias("dropped_rows"),
    )
    messages = [
        ("missing_rows", "Dropped %d rows with missing values"),
        ("bad_date_rows", "Dropped %d rows with unparseable dates"),
        ("not_positive_rows", "Dropped %d rows with negative/zero quantity or price"),
    ]
    issues = F.array_compact(
        F.array(*[F.when(F.col(n) > 0, F.format_string(text, F.col(n))) for n, text in messages])
    )
    return counts.withColumns(
        {"clean_rows": F.col("original_rows") - F.col("dropped_rows"), "issues": issues}
    )


def orders_table(clean: DataFrame) -> DataFrame:
    """The standardised order-line table."""
    return clean.select(
        F.col("invoice").alias("invoice_id"),
        F.col("customer").alias("customer_code"),
        F.col("date").alias("order_date"),
        "product",
        "quantity",
        "price",
        "total_price",
        "country",
    )
