"""Small column expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date layouts tried, in order, when a string is read as a timestamp.
TIMESTAMP_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
]
DATE_LIKE = r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"


def quoted(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def timestamp_sql(value: str) -> str:
    """SQL for the timestamp of a string in any known layout, else null.

    The pattern test keeps ordinary text away from the parsers. The plain cast also
    reads fractions of a second and zone offsets.
    """
    tries = ", ".join(f"try_to_timestamp(trim({value}), r\"{layout}\")" for layout in TIMESTAMP_LAYOUTS)
    return (
        f"CASE WHEN {value} RLIKE r'{DATE_LIKE}' "
        f"THEN coalesce(try_cast(trim({value}) AS timestamp), {tries}) END"
    )


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a timestamp, parsing it only when it is a string."""
    if df.schema[name].dataType.simpleString() == "string":
        return F.expr(timestamp_sql(quoted(name)))
    return F.col(name).cast("timestamp")


def known(value: Column) -> Column:
    """A number with NaN as null. Spark counts NaN as a value, and as the largest one."""
    return F.nullif(value, F.lit(float("nan")))


def known_sql(value: str) -> str:
    """The same for SQL text, as double."""
    return f"nullif(cast({value} AS double), double('NaN'))"


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric value of a column; unreadable strings and NaN become null."""
    kind = df.schema[name].dataType
    if kind.simpleString() == "string":
        return known(F.trim(F.col(name)).try_cast("double"))
    return known(F.col(name)) if isinstance(kind, T.FractionalType) else F.col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    """True for null and, in a column of floating-point numbers, for NaN."""
    column = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """``top / bottom`` in double, ``default`` where the divisor is zero or null."""
    low = bottom.cast("double")
    return F.when(low != 0, top.cast("double") / low).otherwise(F.lit(default))


def percent_change(current: Column, prior: Column) -> Column:
    """Change of ``current`` against ``prior`` in percent; 0 when ``prior`` is 0."""
    now, then = current.cast("double"), prior.cast("double")
    return F.when(then != 0, (now - then) / then * 100).otherwise(F.lit(0.0))


def total(value: Column) -> Column:
    """Sum as double, without NaN. Decimals are added exactly first, so the result does
    not depend on how rows are spread over partitions."""
    return F.coalesce(F.sum(known(value)).cast("double"), F.lit(0.0))


def mean(value: Column) -> Column:
    """Sum over count without NaN, in double (``avg`` on decimals would round to a scale)."""
    return F.sum(known(value)).cast("double") / F.count(known(value))


def month_of(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def contains_any(value: Column, words: Sequence[str]) -> Column:
    """True when the string holds any of the words."""
    return value.rlike("|".join(re.escape(word) for word in words))


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery: its columns can be used
    in another frame's expressions without a join."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row")).scalar()


def percent_text(value: Column, digits: int = 1, signed: bool = False) -> Column:
    return F.format_string(f"%{'+' if signed else ''}.{digits}f%%", value.cast("double"))


def titled(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))


def literal(text: str) -> str:
    """Text to put inside a ``format_string`` template."""
    return text.replace("%", "%%")
