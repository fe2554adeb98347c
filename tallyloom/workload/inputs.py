"""Views of the driver's tables in the roles the operators expect.

Money is read as DECIMAL(12,2), so sums are exact and do not depend on how rows are
partitioned. Each view has a SQL twin below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """A module's queries, their SQL, and the decorator that registers a query, with its SQL
    where there is one."""
    queries: dict[str, Callable] = {}
    sqls: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(function):
            queries[name] = function
            if sql is not None:
                sqls[name] = sql
            return function

        return keep

    return queries, sqls, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str):
    return F.col(name).cast("decimal(12,2)")


def sales_lines(spark: SparkSession, sf_dir: str, product: bool = False, country: bool = False) -> DataFrame:
    """Order lines; product and country are joined in only where a query needs them."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    extra = []
    if product:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        extra.append(F.col("p_name").alias("product"))
    if country:
        lines = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        extra.append(F.col("n_name").alias("country"))
    return lines.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("line_id"),
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        money("l_extendedprice").alias("total_price"),
        *extra,
    )


LINES = """
lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS line_id,
         o_orderkey AS invoice_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS total_price,
         p_name AS product, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
)"""


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order log as an uncleaned retail export. Defects follow modulus
    rules, because the tables themselves have none."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    price = F.expr("CAST(cents div CAST(l_quantity AS BIGINT) AS DECIMAL(14,0)) * 0.01BD")
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumn("cents", cents)
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    quantity = F.col("l_quantity").cast("bigint")
    return lines.select(
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.col("p_name").alias("Description"),
        F.when(F.col("l_partkey") % 23 == 0, -quantity).otherwise(quantity).alias("Quantity"),
        F.when(F.col("o_orderkey") % 29 == 3, "not a date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("InvoiceDate"),
        F.when(F.col("l_partkey") % 31 != 5, price).alias("UnitPrice"),
        F.when(F.col("o_orderkey") % 17 == 0, None)
        .when(F.col("o_custkey") % 97 == 1, "nan")
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")))
        .alias("CustomerID"),
        F.when(F.col("o_custkey") % 13 != 0, F.col("n_name")).alias("Country"),
    )


# The same export, and which rule drops each row.
RAW_LOG = """
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice, p_name AS product,
         CASE WHEN l_partkey % 23 = 0 THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS quantity,
         CASE WHEN o_orderkey % 29 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) END AS bought_at,
         CASE WHEN l_partkey % 31 <> 5
              THEN CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(14,0))
                   * CAST(0.01 AS DECIMAL(3,2)) END AS price,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_custkey % 97 = 1 THEN 'nan'
              ELSE CAST(o_custkey AS VARCHAR) END AS customer,
         CASE WHEN o_custkey % 13 <> 0 THEN n_name END AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
), tagged AS (
  SELECT *, CASE WHEN customer IS NULL OR price IS NULL THEN 'missing'
                 WHEN bought_at IS NULL THEN 'bad_date'
                 WHEN NOT (quantity > 0 AND price > 0) THEN 'not_positive'
                 WHEN customer = 'nan' THEN 'no_customer' END AS drop_reason
  FROM raw
), clean AS (
  SELECT invoice, customer, bought_at, product, quantity, price, quantity * price AS total_price,
         coalesce(country, 'Unknown') AS country
  FROM tagged WHERE drop_reason IS NULL
)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered customers with their country."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").cast("string").alias("customer_code"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
        )
    )


CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS name, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, as a generic table with an amount."""
    return table(spark, sf_dir, "orders").withColumn("o_totalprice", money("o_totalprice"))
