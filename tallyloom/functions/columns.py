"""Finding columns by name, alias, keyword and type. Works on the schema only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The accepted header spellings of each transaction field.
TRANSACTION_ALIASES = {
    "invoice": ["invoiceno", "invoice_no", "invoice", "order_id", "orderid"],
    "customer": ["customerid", "customer_id", "customer"],
    "date": ["invoicedate", "invoice_date", "order_date", "orderdate", "date"],
    "product": ["description", "product", "productname", "product_name", "item"],
    "quantity": ["quantity", "qty"],
    "price": ["unitprice", "unit_price", "price"],
    "country": ["country"],
}
OPTIONAL_FIELDS = frozenset({"country"})

# Keywords that find a column's role in an arbitrary table.
REVENUE_KEYWORDS = ["total_price", "revenue", "amount", "sales", "price"]
CUSTOMER_KEYWORDS = ["customer", "client", "user"]
INVOICE_KEYWORDS = ["invoice", "order"]
DATE_KEYWORDS = ["date", "time"]
PRODUCT_KEYWORDS = ["product", "item", "sku", "description"]
PLACE_KEYWORDS = ["country", "state", "region", "city"]
BREAKDOWN_KEYWORDS = ["country", "state", "region", "city", "department", "category"]
ENTITY_REVENUE_KEYWORDS = ["revenue", "price", "amount", "salary", "spend", "sales", "total"]
ENTITY_PLACE_KEYWORDS = ["country", "state", "region", "dept", "department", "city"]
WORKER_KEYWORDS = ["id", "employee"]
SALARY_KEYWORDS = ["salary", "wage", "comp"]
TENURE_KEYWORDS = ["tenure", "year"]
ATTRITION_KEYWORDS = ["attrition", "left", "churn"]


def normalise(name: str) -> str:
    return name.lower().replace(" ", "_")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def match_aliases(names: Sequence[str], aliases: dict[str, list[str]] = TRANSACTION_ALIASES) -> dict[str, str | None]:
    """Logical field -> actual column (or None); the alias order decides."""
    by_spelling = {normalise(name): name for name in names}
    return {
        field: next((by_spelling[s] for s in spellings if s in by_spelling), None)
        for field, spellings in aliases.items()
    }


def missing_fields(names: Sequence[str]) -> list[str]:
    """One message for each required transaction field that has no column."""
    found = match_aliases(names)
    return [
        f"Missing required column: {field}"
        for field, column in found.items()
        if column is None and field not in OPTIONAL_FIELDS
    ]


def standardise(df: DataFrame) -> DataFrame:
    """Rename the recognised columns to their logical field names."""
    renames = {column: field for field, column in match_aliases(df.columns).items() if column}
    return df.withColumnsRenamed(renames)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_complex(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def find_column(
    df: DataFrame,
    keywords: Iterable[str],
    numeric: bool | None = None,
    exclude: Iterable[str] = (),
) -> str | None:
    """First column, in table order, whose lower-cased name contains a keyword."""
    keywords = list(keywords)
    skip = set(exclude)
    for field in df.schema.fields:
        if field.name in skip or (numeric is not None and is_numeric(field.dataType) != numeric):
            continue
        if any(word in field.name.lower() for word in keywords):
            return field.name
    return None


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def measure_columns(df: DataFrame, suffixes: tuple[str, ...] = ("id", "code")) -> list[str]:
    """Numeric columns that do not look like identifiers."""
    return [name for name in numeric_columns(df) if not name.lower().endswith(suffixes)]


def clustering_features(df: DataFrame) -> list[str]:
    """Measures to cluster on; identifiers join in only when too few remain."""
    measures = measure_columns(df)
    return measures if len(measures) >= 2 else numeric_columns(df)


def display_name(name: str) -> str:
    """``unit_price`` -> ``Unit Price``."""
    return name.replace("_", " ").title()
