"""Cleaning, RFM, key figures, trends, breakdowns and directories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import standardise
from tallyloom.operators import cleaning, dashboard, directory, rfm
from tallyloom.plans import dashboards
from tallyloom.workload.inputs import (
    CUSTOMERS,
    LINES,
    RAW_LOG,
    customers,
    order_log,
    raw_log,
    registry,
    sales_lines,
    table,
)

START, END = date(1998, 1, 1), date(1998, 12, 31)
TODAY = date(2001, 8, 2)

Q, SQL, query = registry()


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- cleaning --------------------------------------------------------------


@query(
    "standardize_columns",
    f"""WITH {RAW_LOG} SELECT invoice, customer, coalesce(strftime(bought_at, '%Y-%m-%d %H:%M:%S'), 'not a date') AS date, product, quantity,
    CAST(price AS DOUBLE) AS price, country FROM raw""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = standardise(raw_log(spark, sf))
    return doubles(df.withColumn("customer", F.trim("customer")), "price")


@query(
    "clean_transactions",
    f"""WITH {RAW_LOG}
    SELECT invoice, customer, strftime(bought_at, '%Y-%m-%d') AS date, product, quantity, CAST(price AS DOUBLE) AS price,
           CAST(total_price AS DOUBLE) AS total_price, country FROM clean""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.clean_transactions(raw_log(spark, sf))
    return doubles(df.withColumn("date", F.date_format("date", "yyyy-MM-dd")), "price", "total_price")


@query(
    "clean_stats",
    f"""WITH {RAW_LOG}, c AS (
      SELECT count(*) AS original_rows,
             count(*) FILTER (drop_reason = 'missing') AS missing_rows,
             count(*) FILTER (drop_reason = 'bad_date') AS bad_date_rows,
             count(*) FILTER (drop_reason = 'not_positive') AS not_positive_rows,
             count(drop_reason) AS dropped_rows
      FROM tagged)
    SELECT *, original_rows - dropped_rows AS clean_rows,
           concat('Dropped ', missing_rows, ' rows with missing values; Dropped ', bad_date_rows,
                  ' rows with unparseable dates; Dropped ', not_positive_rows,
                  ' rows with negative/zero quantity or price') AS issues
    FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_stats(raw_log(spark, sf)).withColumn("issues", F.array_join("issues", "; "))


@query(
    "clean_stats_nan",
    f"""WITH {RAW_LOG}, t AS (
      SELECT CASE WHEN customer IS NULL OR price IS NULL OR quantity % 7 = 3 THEN 'missing' ELSE drop_reason END AS drop_reason
      FROM tagged)
    SELECT count(*) AS original_rows, count(*) FILTER (drop_reason = 'missing') AS missing_rows,
           count(*) FILTER (drop_reason = 'bad_date') AS bad_date_rows,
           count(*) FILTER (drop_reason = 'not_positive') AS not_positive_rows,
           count(drop_reason) AS dropped_rows, count(*) - count(drop_reason) AS clean_rows FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A price that is not a number is a missing one, in a column of numbers as in one of text."""
    price = F.when(F.col("Quantity") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("UnitPrice").cast("double"))
    raw = raw_log(spark, sf).withColumn("UnitPrice", price)
    stats = cleaning.clean_stats(raw).drop("issues")
    return stats.intersect(cleaning.clean_stats(raw.withColumn("UnitPrice", price.cast("string"))).drop("issues"))


@query(
    "generic_kpis_nan",
    """SELECT count(*) AS records, 5 AS features, 2 AS numeric_features,
              (count(*) FILTER (l_quantity = 7) + count(*) FILTER (l_linenumber = 2))::DOUBLE * 100 / (count(*) * 5)::DOUBLE AS missing_pct
       FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
        "l_discount",
        F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"),
        "l_linestatus",
        "l_shipdate",
    )
    return dashboard.generic_kpis(lines)


@query(
    "orders_output",
    f"""WITH {RAW_LOG}
    SELECT invoice AS invoice_id, customer AS customer_code, strftime(bought_at, '%Y-%m-%d') AS order_date, product, quantity,
           CAST(price AS DOUBLE) AS price, CAST(total_price AS DOUBLE) AS total_price, country FROM clean""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.orders_table(cleaning.clean_transactions(raw_log(spark, sf)))
    return doubles(df.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")), "price", "total_price")


# --- RFM -------------------------------------------------------------------

RFM_BASE = f"""{RAW_LOG}, modes AS (
  SELECT customer, country FROM (
    SELECT customer, country, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, country) AS place
    FROM clean GROUP BY customer, country) WHERE place = 1
), activity AS (
  SELECT customer AS customer_code, max(bought_at) AS last_purchase, count(DISTINCT invoice) AS frequency,
         sum(total_price) AS monetary
  FROM clean GROUP BY customer
), base AS (
  SELECT customer_code, country, frequency, monetary,
         date_diff('day', CAST(last_purchase AS DATE), (SELECT CAST(max(bought_at) AS DATE) + 1 FROM clean)) AS recency_days
  FROM activity JOIN modes ON customer = customer_code
)"""


def fifth_sql(metric: str, key: str = "customer_code") -> str:
    rank = f"(row_number() OVER (ORDER BY {metric}, {key}))"
    return f"CAST(greatest(1, (({rank} - 1) * 5 + (count(*) OVER () - 2)) // (count(*) OVER () - 1)) AS INTEGER)"


RFM_SCORES = f"""{RFM_BASE}, cuts AS (
  SELECT quantile_cont(recency_days, 0.2) AS a, quantile_cont(recency_days, 0.4) AS b,
         quantile_cont(recency_days, 0.6) AS c, quantile_cont(recency_days, 0.8) AS d FROM base
), scored AS (
  SELECT customer_code, country, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary,
         5 - CAST(recency_days > a AS INTEGER) - CAST(recency_days > b AS INTEGER)
           - CAST(recency_days > c AS INTEGER) - CAST(recency_days > d AS INTEGER) AS r_score,
         {fifth_sql('frequency')} AS f_score, {fifth_sql('monetary')} AS m_score
  FROM base, cuts
), segmented AS (
  SELECT *, CASE WHEN r_score >= 4 AND m_score >= 4 THEN 'VIP Customers' WHEN f_score >= 4 THEN 'Loyal Customers'
                 WHEN r_score >= 3 AND f_score <= 2 THEN 'Potential Customers'
                 ELSE 'At-Risk Customers' END AS segment_label
  FROM scored
)"""


def base_of(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm_base(cleaning.clean_transactions(raw_log(spark, sf)))


def scores_of(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm_scores(base_of(spark, sf))


def segments_of(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm_segments(scores_of(spark, sf))


@query(
    "rfm_base",
    f"""WITH {RFM_BASE} SELECT customer_code, country, frequency, CAST(monetary AS DOUBLE) AS monetary,
        recency_days FROM base""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(base_of(spark, sf), "monetary").drop("last_purchase")


@query(
    "rfm_scores",
    f"WITH {RFM_SCORES} SELECT *, r_score * 100 + f_score * 10 + m_score AS rfm_score FROM scored",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(scores_of(spark, sf), "monetary").drop("last_purchase")


@query("rfm_segments", f"WITH {RFM_SCORES} SELECT customer_code, segment_label FROM segmented")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(spark, sf).select("customer_code", "segment_label")


@query(
    "segment_stats",
    f"""WITH {RFM_SCORES}
    SELECT segment_label, count(*) AS customers, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM segmented) AS share_pct,
           CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency,
           CAST(sum(frequency) AS DOUBLE) / count(*) AS avg_frequency,
           CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_monetary
    FROM segmented GROUP BY segment_label""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.segment_stats(segments_of(spark, sf))


RFM_GENERIC = f"""activity AS (
  SELECT o_custkey AS customer_code, max(o_orderdate) AS last, count(*) AS frequency,
         sum(CAST(o_totalprice AS DECIMAL(12,2))) AS monetary
  FROM orders GROUP BY o_custkey
), base AS (
  SELECT *, date_diff('day', CAST(last AS DATE), (SELECT CAST(max(last) AS DATE) FROM activity)) + 1 AS recency_days
  FROM activity
), scored AS (
  SELECT customer_code, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary,
         6 - {fifth_sql('recency_days')} AS r_score, {fifth_sql('frequency')} AS f_score,
         {fifth_sql('monetary')} AS m_score
  FROM base
), segmented AS (
  SELECT *, r_score * 100 + f_score * 10 + m_score AS rfm_score,
         CASE WHEN r_score >= 4 AND m_score >= 4 THEN 'VIP Customers' WHEN f_score >= 4 THEN 'Loyal Customers'
              WHEN r_score >= 3 AND f_score <= 2 THEN 'Potential Customers'
              ELSE 'At-Risk Customers' END AS segment_label
  FROM scored
)"""


def generic_of(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm_segments(rfm.rfm_generic(order_log(spark, sf), "o_custkey", "o_orderdate", "o_totalprice"))


@query("rfm_generic", f"WITH {RFM_GENERIC} SELECT * FROM segmented")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(generic_of(spark, sf), "monetary")


@query("rfm_page", f"WITH {RFM_GENERIC} SELECT * FROM segmented ORDER BY customer_code LIMIT 25 OFFSET 25")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(directory.key_page(generic_of(spark, sf), "customer_code", page=2), "monetary")


@query(
    "rfm_distribution",
    f"""WITH {RFM_GENERIC}, grid AS (SELECT * FROM (VALUES ('recency'), ('frequency')) d(dimension), range(1, 6) s(score)),
    found AS (
      SELECT 'recency' AS dimension, r_score AS score, count(*) AS n FROM segmented GROUP BY r_score
      UNION ALL SELECT 'frequency', f_score, count(*) FROM segmented GROUP BY f_score)
    SELECT grid.dimension, CAST(grid.score AS INTEGER) AS score, coalesce(n, 0) AS customers
    FROM grid LEFT JOIN found ON grid.dimension = found.dimension AND grid.score = found.score
    UNION ALL SELECT 'monetary', m_score, count(*) FROM segmented GROUP BY m_score""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.score_distribution(generic_of(spark, sf))


RFM_ASOF = f"""{CUSTOMERS}, {LINES}, spans AS (
  SELECT customer_id, date_diff('day', max(order_date), DATE '{TODAY}') AS recency_days,
         count(DISTINCT invoice_id) AS frequency, sum(total_price) AS money
  FROM customers JOIN lines USING (customer_id) GROUP BY customer_id
), places AS (
  SELECT customer_id, recency_days, frequency, CAST(money AS DOUBLE) AS monetary, count(*) OVER () AS n,
         rank() OVER (ORDER BY recency_days) - 1 AS r, rank() OVER (ORDER BY frequency) - 1 AS f,
         rank() OVER (ORDER BY money) - 1 AS m
  FROM spans
), asof_scores AS (
  SELECT customer_id, recency_days, frequency, monetary,
         CAST(6 - (r * 4 // greatest(n - 1, 1) + 1) AS INTEGER) AS r_score,
         CAST(f * 4 // greatest(n - 1, 1) + 1 AS INTEGER) AS f_score,
         CAST(m * 4 // greatest(n - 1, 1) + 1 AS INTEGER) AS m_score
  FROM places
), rfm AS (
  SELECT *, r_score * 100 + f_score * 10 + m_score AS rfm_score FROM asof_scores
), segments AS (
  SELECT customer_id, CASE WHEN r_score >= 4 AND m_score >= 4 THEN 'VIP Customers' WHEN f_score >= 4 THEN 'Loyal Customers'
                           WHEN r_score >= 3 AND f_score <= 2 THEN 'Potential Customers'
                           ELSE 'At-Risk Customers' END AS segment_label
  FROM rfm
)"""


def asof_of(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm_asof(customers(spark, sf), sales_lines(spark, sf), TODAY)


def relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four relational tables: customers, order lines, scores, segments."""
    scores = asof_of(spark, sf)
    return customers(spark, sf), sales_lines(spark, sf), scores, rfm.rfm_segments(scores)


@query("rfm_asof", f"WITH {RFM_ASOF} SELECT * FROM rfm")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(asof_of(spark, sf), "monetary")


@query(
    "rfm_scores_pctrank",
    f"WITH {RFM_ASOF} SELECT customer_id, r_score, f_score, m_score FROM rfm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return asof_of(spark, sf).select("customer_id", "r_score", "f_score", "m_score")


# --- key figures -----------------------------------------------------------


@query(
    "kpi_summary",
    f"""WITH {LINES}, w AS (
      SELECT *, order_date BETWEEN DATE '{START}' AND DATE '{END}' AS cur,
             order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AS prev FROM lines
    ), s AS (
      SELECT CAST(coalesce(sum(total_price) FILTER (cur), 0) AS DOUBLE) AS cr, count(*) FILTER (cur) AS co,
             count(DISTINCT customer_id) FILTER (cur) AS cc,
             CAST(coalesce(sum(total_price) FILTER (prev), 0) AS DOUBLE) AS pr, count(*) FILTER (prev) AS po,
             count(DISTINCT customer_id) FILTER (prev) AS pc,
             (SELECT count(*) FROM (SELECT customer_id FROM lines GROUP BY customer_id HAVING count(*) > 1)) AS rep
      FROM w
    ), t AS (SELECT *, cr / co AS ca, pr / po AS pa FROM s)
    SELECT cr AS total_revenue, co AS order_lines, cc AS total_customers, ca AS avg_order_value,
           rep * 100.0::DOUBLE / cc AS repeat_customer_rate, (cr - pr) / pr * 100 AS revenue_change_pct,
           (co::DOUBLE - po::DOUBLE) / po::DOUBLE * 100 AS orders_change_pct,
           (cc::DOUBLE - pc::DOUBLE) / pc::DOUBLE * 100 AS customers_change_pct, (ca - pa) / pa * 100 AS aov_change_pct
    FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.kpi_summary(sales_lines(spark, sf), START, END)


@query(
    "repeat_customers",
    f"""WITH {LINES}, c AS (SELECT customer_id, count(*) AS n FROM lines GROUP BY customer_id)
    SELECT count(*) FILTER (n > 1) AS repeat_customers, count(*) AS customers,
           (count(*) FILTER (n > 1) * 100)::DOUBLE / count(*)::DOUBLE AS repeat_rate FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.repeat_customers(sales_lines(spark, sf))


@query(
    "commerce_kpis",
    f"""WITH {LINES}, c AS (SELECT customer_id, count(DISTINCT invoice_id) AS n FROM lines GROUP BY customer_id)
    SELECT CAST(sum(total_price) AS DOUBLE) AS total_revenue, count(DISTINCT invoice_id) AS total_orders,
           count(DISTINCT customer_id) AS total_customers,
           CAST(sum(total_price) AS DOUBLE) / count(DISTINCT invoice_id) AS avg_order_value,
           (SELECT (count(*) FILTER (n > 1) * 100)::DOUBLE / count(*)::DOUBLE FROM c) AS repeat_rate
    FROM lines""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.commerce_kpis(sales_lines(spark, sf), "customer_id", "invoice_id", "total_price")


@query(
    "workforce_kpis",
    """SELECT count(DISTINCT l_suppkey) AS workforce,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_salary,
              CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_tenure,
              (count(*) FILTER (l_linenumber = 1) * 100)::DOUBLE / count(*)::DOUBLE AS attrition_rate
       FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("pay"),
        F.col("l_quantity").cast("bigint").alias("years"),
        "l_linenumber",
    )
    return dashboard.workforce_kpis(df, "l_suppkey", "pay", "years", "l_linenumber")


@query(
    "generic_kpis",
    f"""WITH {RAW_LOG}
    SELECT count(*) AS records, 7 AS features, 2 AS numeric_features,
           ((count(*) - count(customer) + count(*) - count(price) + count(*) - count(country)) * 100)::DOUBLE
             / (count(*) * 7)::DOUBLE AS missing_pct FROM raw""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.generic_kpis(raw_log(spark, sf))


@query(
    "sales_summary",
    """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_revenue, count(*) AS order_lines,
              CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_order_value FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.sales_summary(order_log(spark, sf), "o_totalprice")


# --- trends ----------------------------------------------------------------

MONTHS = """months AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
         count(*) AS orders
  FROM orders GROUP BY 1
)"""


@query(
    "revenue_trend",
    f"""WITH {LINES}
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start, CAST(sum(total_price) AS DOUBLE) AS revenue,
           count(*) AS orders, strftime(date_trunc('month', order_date), '%Y-%m') AS month
    FROM lines WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 4""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.revenue_trend(sales_lines(spark, sf), START, END)


@query("trend_last12", f"WITH {MONTHS} SELECT * FROM months ORDER BY month DESC LIMIT 12")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.trend_last(order_log(spark, sf), "o_orderdate", "o_totalprice")


@query(
    "chart_trend",
    f"""WITH {MONTHS} SELECT month, revenue AS total, revenue / orders AS average FROM months ORDER BY month LIMIT 12""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.chart_trend(order_log(spark, sf), "o_orderdate", "o_totalprice")


@query(
    "monthly_sales",
    f"""WITH {MONTHS}, g AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS prior FROM months)
    SELECT month, revenue, orders, revenue / orders AS avg_order_value,
           CASE WHEN prior > 0 THEN (revenue - prior) / prior * 100 END AS growth_pct FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.monthly_sales(order_log(spark, sf), "o_orderdate", "o_totalprice")


# Months divisible by 5 have no rows here, so that gaps exist.
@query(
    "monthly_trend_gapfilled",
    """WITH kept AS (SELECT * FROM orders WHERE month(o_orderdate) % 5 <> 0), m AS (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
             CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM kept GROUP BY 1
    ), spine AS (
      SELECT CAST(unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM m
    ), f AS (
      SELECT month_start, coalesce(total, 0.0::DOUBLE) AS total FROM spine LEFT JOIN m USING (month_start)
    ), g AS (SELECT *, lag(total) OVER (ORDER BY month_start) AS prior FROM f)
    SELECT month_start, total, CASE WHEN prior > 0 THEN (total - prior) / prior * 100 END AS change_pct FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = order_log(spark, sf).where(F.month("o_orderdate") % 5 != 0)
    return dashboard.monthly_gapfilled(kept, "o_orderdate", "o_totalprice")


# --- breakdowns ------------------------------------------------------------


def top_sql(by: str, k: int, label: str, source: str = "lines", amount: str = "total_price") -> str:
    return f"""SELECT {by} AS {label}, CAST(sum({amount}) AS DOUBLE) AS revenue, count({amount}) AS orders
               FROM {source} GROUP BY 1 ORDER BY revenue DESC, {label} LIMIT {k}"""


@query("country_revenue", f"WITH {LINES} {top_sql('country', 10, 'country')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.country_revenue(sales_lines(spark, sf, country=True))


@query(
    "top_products",
    f"""WITH {LINES} SELECT product, CAST(sum(total_price) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM lines GROUP BY product ORDER BY revenue DESC, product LIMIT 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_products(sales_lines(spark, sf, product=True))


@query("top_items", f"WITH {LINES} {top_sql('product', 8, 'item')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales_lines(spark, sf, product=True)
    return dashboard.top_by_amount(lines, "product", "total_price", 8, "item", label_length=30)


@query("geo_breakdown", f"WITH {LINES} {top_sql('country', 8, 'place')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales_lines(spark, sf, country=True)
    return dashboard.top_by_amount(lines, "country", "total_price", 8, "place")


@query("sales_top_products", f"WITH {LINES} {top_sql('product', 10, 'product')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales_lines(spark, sf, product=True)
    return dashboard.top_by_amount(lines, "product", "total_price", 10, label_length=35)


@query("sales_by_country", f"WITH {LINES} {top_sql('country', 10, 'country')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_by_amount(sales_lines(spark, sf, country=True), "country", "total_price", 10)


@query(
    "category_share",
    """SELECT o_orderpriority AS label, count(*) AS count,
              count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS percentage
       FROM orders GROUP BY 1 ORDER BY count DESC, label LIMIT 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.category_share(order_log(spark, sf), "o_orderpriority")


@query(
    "chart_category",
    "SELECT p_brand AS label, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, label LIMIT 8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.chart_category(table(spark, sf, "part"), "p_brand")


@query(
    "segment_distribution",
    f"""WITH {RFM_ASOF}
    SELECT segment_label, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           count(*) * 100.0::DOUBLE / (SELECT count(*) FROM segments) AS percentage
    FROM segments LEFT JOIN rfm USING (customer_id) GROUP BY segment_label""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, segments = relations(spark, sf)
    return dashboard.segment_distribution(segments.select("customer_id", "segment_label"), scores)


@query(
    "histogram",
    """WITH v AS (SELECT l_extendedprice AS v FROM lineitem),
    s AS (SELECT min(v) AS lo, max(v) AS hi, least(10, count(DISTINCT v)) AS n FROM v),
    f AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * n) AS INTEGER), n - 1) AS bin, count(*) AS c FROM v, s GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * ((hi - lo) / n) AS bin_start, coalesce(c, 0) AS frequency
    FROM s, range(0, 10) g(bin) LEFT JOIN f ON f.bin = g.bin WHERE g.bin < n""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


# --- directories -----------------------------------------------------------

DIRECTORY = f"""{RFM_ASOF}, totals AS (
  SELECT customer_id, count(*) AS total_orders, CAST(sum(total_price) AS DOUBLE) AS total_revenue,
         max(order_date) AS last_purchase_date
  FROM lines GROUP BY customer_id
), directory AS (
  SELECT c.customer_id, c.customer_code, c.name, c.country, coalesce(t.total_orders, 0) AS total_orders,
         t.last_purchase_date, r.recency_days, r.frequency, r.monetary, r.r_score, r.f_score, r.m_score, r.rfm_score,
         s.segment_label, coalesce(t.total_revenue, 0.0::DOUBLE) AS total_revenue
  FROM customers c LEFT JOIN totals t USING (customer_id) LEFT JOIN rfm r USING (customer_id)
       LEFT JOIN segments s USING (customer_id)
)"""


def directory_of(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(directory.customer_directory(*relations(spark, sf)), "monetary")


@query("customer_directory", f"WITH {DIRECTORY} SELECT * FROM directory")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return directory_of(spark, sf)


@query(
    "customer_directory_filtered",
    f"""WITH {DIRECTORY} SELECT * FROM directory
    WHERE segment_label = 'VIP Customers' AND country ILIKE '%nation_1%'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return directory.filter_directory(directory_of(spark, sf), segment=rfm.VIP, country="nation_1")


@query(
    "customer_search",
    f"""WITH {CUSTOMERS} SELECT * FROM customers WHERE name ILIKE '%#0000001%' OR customer_code ILIKE '%#0000001%'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return directory.search(customers(spark, sf), "#0000001", ["name", "customer_code"])


@query(
    "customer_page",
    f"""WITH {DIRECTORY}, counts AS (
      SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 25) AS BIGINT), 1) AS total_pages FROM directory
    ), page AS (SELECT * FROM directory ORDER BY total_revenue DESC, customer_id LIMIT 25 OFFSET 50)
    SELECT page.*, counts.* FROM page, counts""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    whole = directory_of(spark, sf)
    counts = directory.page_counts(customers(spark, sf))
    return directory.sort_page(whole, "customer_id", "total_revenue", True, page=3).withColumns(
        {
            "total": counts.select("total").scalar(),
            "total_pages": counts.select("total_pages").scalar(),
        }
    )


@query(
    "customer_detail",
    f"""WITH {DIRECTORY}
    SELECT d.*, total_revenue / total_orders AS avg_order_value,
           (SELECT string_agg(invoice_id, ',' ORDER BY order_date DESC, invoice_id, line_id)
            FROM (SELECT * FROM lines WHERE customer_id = 7 ORDER BY order_date DESC, invoice_id, line_id LIMIT 50)) AS orders,
           CASE segment_label
             WHEN 'VIP Customers' THEN 'Offer exclusive loyalty rewards|Provide early access to new products|Assign dedicated account manager'
             WHEN 'Loyal Customers' THEN 'Cross-sell complementary products|Upsell premium tiers|Send personalised thank-you offers'
             WHEN 'Potential Customers' THEN 'Send promotional offers|Encourage product discovery|Offer first-time repeat-purchase discount'
             WHEN 'At-Risk Customers' THEN 'Launch win-back email campaign|Offer special retention discount|Schedule proactive outreach'
             ELSE 'Review purchase history|Engage with personalised communication' END AS recommended_actions
    FROM directory d WHERE customer_id = 7""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail = directory.customer_detail(7, *relations(spark, sf))
    return doubles(detail, "monetary").withColumns(
        {
            "orders": F.array_join(F.transform("orders", lambda o: o["invoice_id"].cast("string")), ","),
            "recommended_actions": F.array_join("recommended_actions", "|"),
        }
    )


@query(
    "segment_actions",
    f"""WITH {RFM_ASOF}, every AS (
      SELECT customer_id, segment_label FROM customers LEFT JOIN segments USING (customer_id))
    SELECT customer_id, CASE segment_label
             WHEN 'VIP Customers' THEN 'Offer exclusive loyalty rewards|Provide early access to new products|Assign dedicated account manager'
             WHEN 'Loyal Customers' THEN 'Cross-sell complementary products|Upsell premium tiers|Send personalised thank-you offers'
             WHEN 'Potential Customers' THEN 'Send promotional offers|Encourage product discovery|Offer first-time repeat-purchase discount'
             WHEN 'At-Risk Customers' THEN 'Launch win-back email campaign|Offer special retention discount|Schedule proactive outreach'
             ELSE 'Review purchase history|Engage with personalised communication' END AS actions
    FROM every""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    everyone, _, _, segments = relations(spark, sf)
    labelled = everyone.select("customer_id").join(segments.select("customer_id", "segment_label"), "customer_id", "left")
    actions = F.array_join(directory.segment_actions(F.col("segment_label")), "|")
    return labelled.select("customer_id", actions.alias("actions"))


@query(
    "recent_orders",
    f"""WITH {LINES} SELECT customer_id, line_id, invoice_id, order_date, CAST(total_price AS DOUBLE) AS total_price,
           row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, invoice_id, line_id) AS recent_rank
    FROM lines QUALIFY recent_rank <= 50""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(directory.recent_orders(sales_lines(spark, sf)).drop("quantity"), "total_price")


@query(
    "latest_per_group",
    """SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, events.ts DESC, event_id DESC) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "ts", (F.col("event_type") == "purchase").alias("active")
    )
    latest = directory.latest_per_group(events, "user_id", "active", "ts", "event_id")
    return latest.drop("active").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "entity_directory",
    f"""WITH {LINES}
    SELECT CAST(customer_id AS VARCHAR) AS customer_code, count(*) AS total_orders,
           CAST(sum(total_price) AS DOUBLE) AS total_revenue, arg_min(country, line_id) AS country
    FROM lines GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales_lines(spark, sf, country=True)
    return directory.entity_directory(lines, "customer_id", "line_id", "total_price", "country")


@query(
    "entity_detail",
    """WITH r AS (SELECT * FROM orders WHERE o_custkey = 11), f AS (SELECT * FROM r ORDER BY o_orderkey LIMIT 1),
    s AS (SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS rev, max(o_orderdate) AS last FROM r)
    SELECT '11' AS customer_code, n AS total_orders, rev AS total_revenue, f.o_orderstatus AS country,
           strftime(last, '%Y-%m-%d') AS last_activity, CAST(f.o_orderkey AS VARCHAR) AS first_order,
           f.o_orderpriority AS first_priority,
           (SELECT string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM (SELECT * FROM r ORDER BY o_orderkey LIMIT 10)) AS records
    FROM s, f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = order_log(spark, sf)
    summary = directory.entity_summary(
        log, "o_custkey", "11", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"
    )
    records = directory.entity_records(log, "o_custkey", "11", "o_orderkey")
    listed = records.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    )
    return summary.select(
        "customer_code",
        "total_orders",
        "total_revenue",
        "country",
        F.date_format("last_activity", "yyyy-MM-dd").alias("last_activity"),
        F.col("attributes")["o_orderkey"].alias("first_order"),
        F.col("attributes")["o_orderpriority"].alias("first_priority"),
        listed.scalar().alias("records"),
    )


# --- tables whose columns are not known beforehand ---------------------------


def distinct_counts(df: DataFrame) -> dict[str, int]:
    """Values of each column, as the profile has them; a number per column."""
    return df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()


@query(
    "dashboard_ecommerce",
    f"""WITH {LINES}, c AS (SELECT customer_id, count(DISTINCT invoice_id) AS n FROM lines GROUP BY 1),
    m AS (SELECT strftime(order_date, '%Y-%m') AS label, CAST(sum(quantity) AS DOUBLE) AS value, count(*) AS rows FROM lines
          GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
    few AS (SELECT count(DISTINCT product) BETWEEN 3 AND 200 AS few FROM lines),
    i AS (SELECT CASE WHEN few THEN product ELSE country END AS label, CAST(sum(quantity) AS DOUBLE) AS value, count(*) AS rows
          FROM lines, few GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
    p AS (SELECT country AS label, CAST(sum(quantity) AS DOUBLE) AS value, count(*) AS rows FROM lines
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
    s AS (SELECT CASE WHEN few THEN product ELSE country END AS label, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lines) AS value,
                 count(*) AS rows FROM lines, few GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5)
    SELECT 'kpi' AS section, 'Total Revenue' AS label, CAST(sum(total_price) AS DOUBLE) AS value, NULL::BIGINT AS rows FROM lines
    UNION ALL SELECT 'kpi', 'Total Orders', count(DISTINCT invoice_id)::DOUBLE, NULL FROM lines
    UNION ALL SELECT 'kpi', 'Active Customers', count(DISTINCT customer_id)::DOUBLE, NULL FROM lines
    UNION ALL SELECT 'kpi', 'Repeat Rate', (count(*) FILTER (n > 1) * 100)::DOUBLE / count(*)::DOUBLE, NULL FROM c
    UNION ALL SELECT 'trend', * FROM m UNION ALL SELECT 'items', * FROM i UNION ALL SELECT 'places', * FROM p
    UNION ALL SELECT 'shares', * FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Products are the items where they are few enough for a chart, else countries."""
    lines = sales_lines(spark, sf, product=True, country=True).drop("line_id")
    return dashboards.table_dashboard(lines, distinct_counts(lines), "ecommerce")


STAFF = """staff AS (
  SELECT s_suppkey AS employee_id, n_name AS department, CAST(s_acctbal AS DECIMAL(12,2)) AS salary, s_suppkey % 15 AS years_at_company,
         CASE WHEN s_suppkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS attrition
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


@query(
    "dashboard_workforce",
    f"""WITH {STAFF}, d AS (SELECT department AS label, CAST(sum(salary) AS DOUBLE) AS value, count(*) AS rows FROM staff
                         GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
    s AS (SELECT department AS label, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM staff) AS value, count(*) AS rows FROM staff
          GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5)
    SELECT 'kpi' AS section, 'Total Workforce' AS label, count(DISTINCT employee_id)::DOUBLE AS value, NULL::BIGINT AS rows FROM staff
    UNION ALL SELECT 'kpi', 'Average Salary', CAST(sum(salary) AS DOUBLE) / count(salary), NULL FROM staff
    UNION ALL SELECT 'kpi', 'Average Tenure', sum(years_at_company)::DOUBLE / count(*), NULL FROM staff
    UNION ALL SELECT 'kpi', 'Attrition Rate', (count(*) FILTER (attrition = 'Yes') * 100)::DOUBLE / count(*)::DOUBLE, NULL FROM staff
    UNION ALL SELECT 'items', * FROM d UNION ALL SELECT 'places', * FROM d UNION ALL SELECT 'shares', * FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    staff = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("employee_id"),
            F.col("n_name").alias("department"),
            F.col("s_acctbal").cast("decimal(12,2)").alias("salary"),
            (F.col("s_suppkey") % 15).alias("years_at_company"),
            F.when(F.col("s_suppkey") % 7 == 0, "Yes").otherwise("No").alias("attrition"),
        )
    )
    return dashboards.table_dashboard(staff, distinct_counts(staff), "hr")


@query(
    "dashboard_generic",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value,
                  count(*) AS rows FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
    p AS (SELECT o_orderpriority AS label, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value, count(*) AS rows
          FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
    s AS (SELECT o_orderpriority AS label, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS value, count(*) AS rows
          FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5)
    SELECT 'kpi' AS section, 'Total Records' AS label, count(*)::DOUBLE AS value, NULL::BIGINT AS rows FROM orders
    UNION ALL SELECT 'kpi', 'Total Features', 4, NULL UNION ALL SELECT 'kpi', 'Numeric Variables', 2, NULL
    UNION ALL SELECT 'kpi', 'Missing Cells', 0, NULL
    UNION ALL SELECT 'trend', * FROM m UNION ALL SELECT 'items', * FROM p UNION ALL SELECT 'shares', * FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = order_log(spark, sf).select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    orders = orders.withColumnRenamed("o_orderkey", "record_id")
    return dashboards.table_dashboard(orders, distinct_counts(orders), "generic-tabular")


@query(
    "sales_page",
    f"""WITH {LINES}, m AS (SELECT strftime(order_date, '%Y-%m') AS label, CAST(sum(total_price) AS DOUBLE) AS value, count(*) AS rows
                         FROM lines GROUP BY 1),
    p AS (SELECT product AS label, CAST(sum(total_price) AS DOUBLE) AS value, count(*) AS rows FROM lines
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    c AS (SELECT country AS label, CAST(sum(total_price) AS DOUBLE) AS value, count(*) AS rows FROM lines
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT 'total' AS section, 'revenue' AS label, CAST(sum(total_price) AS DOUBLE) AS value, count(*) AS rows FROM lines
    UNION ALL SELECT 'monthly', * FROM m UNION ALL SELECT 'products', label[1:35], value, rows FROM p
    UNION ALL SELECT 'places', * FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.sales_page(sales_lines(spark, sf, product=True, country=True))


@query(
    "any_directory",
    f"""WITH {STAFF} SELECT department AS customer_code, count(*) AS total_orders, CAST(sum(salary) AS DOUBLE) AS total_revenue,
        'Global' AS country FROM staff GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Departments of a staff list: the place keyword finds the entity itself, which is no place of its own."""
    staff = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("department"),
            F.col("s_suppkey").alias("employee_id"),
            F.col("s_acctbal").cast("decimal(12,2)").alias("salary"),
        )
    )
    return dashboards.any_directory(staff, "employee_id")
