"""Series of events: rolling metrics, decomposition, forecasts, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import series
from tallyloom.workload.inputs import registry, table

Q, SQL, query = registry()

DAILY = """days AS (
  SELECT event_type AS series, ts::DATE AS day, sum(value::DECIMAL(38,9))::DOUBLE AS x FROM events GROUP BY ALL
), ends AS (SELECT series, min(day) AS a, max(day) AS b FROM days GROUP BY 1),
spine AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ends),
daily AS (SELECT series, day, coalesce(x, 0) AS x FROM spine LEFT JOIN days USING (series, day))"""


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "rolling_rows",
    """SELECT event_id, count(value) OVER w AS window_rows, round(avg(value) OVER w, 6) AS rolling_mean,
              min(value) OVER w AS rolling_min, max(value) OVER w AS rolling_max
       FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the last seven events at each event, over all events as one series."""
    rolled = series.rolling_rows(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", "event_id", "value", 7)
    return rounded(rolled.drop("ts", "value"), 6, "rolling_mean")


@query(
    "rolling_week",
    """SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, count(value) OVER w AS window_rows, (sum(value::DECIMAL(38,9)) OVER w)::DOUBLE AS rolling_sum,
              (sum(value::DECIMAL(38,9)) OVER w)::DOUBLE / count(value) OVER w AS rolling_mean
       FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '604799999999 microseconds' PRECEDING AND CURRENT ROW)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the last seven days at each time, over all events as one series."""
    rolled = series.rolling_time(table(spark, sf, "events"), "ts", "value", "7 days")
    return rolled.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "seasonal_decomposition",
    f"""WITH {DAILY}, smooth AS (
      SELECT *, CASE WHEN count(x) OVER w = 7 THEN avg(x) OVER w END AS trend, datediff('day', DATE '1970-01-01', day) % 7 AS phase
      FROM daily WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    ), raw AS (SELECT series, phase, avg(x - trend) AS raw FROM smooth GROUP BY ALL),
    seasons AS (SELECT series, phase, raw - avg(raw) OVER (PARTITION BY series) AS seasonal FROM raw)
    SELECT series, day, x, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(x - trend - seasonal, 6) AS remainder
    FROM smooth JOIN seasons USING (series, phase)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Trend, weekly season and remainder of the daily values of each kind of event."""
    days = series.daily(table(spark, sf, "events"), "event_type", "ts", "value")
    return rounded(series.decompose(days, 7), 6, "trend", "seasonal", "remainder")


@query(
    "forecast_daily",
    f"""WITH {DAILY}, held AS (SELECT series, list(x ORDER BY day) AS v FROM daily GROUP BY 1 HAVING count(*) >= 2),
    grid AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS alpha), grid2 AS (SELECT unnest([0.0, 0.1, 0.3, 0.5])::DOUBLE AS beta),
    tried AS (
      SELECT series, alpha, beta, least(7, len(v) - 1) AS used, list_reduce(
        list_concat(
          [{{'l': v[1], 'b': v[2] - v[1], 'x': v[1], 't': 1::BIGINT, 'off': 0::DOUBLE, 'naive': 0::DOUBLE}}],
          list_transform(v[2:], lambda x: {{'l': 0::DOUBLE, 'b': 0::DOUBLE, 'x': x, 't': 0::BIGINT, 'off': 0::DOUBLE, 'naive': 0::DOUBLE}})),
        lambda s, e: {{
          'l': alpha * e.x + (1 - alpha) * (s.l + s.b),
          'b': beta * (alpha * e.x + (1 - alpha) * (s.l + s.b) - s.l) + (1 - beta) * s.b,
          'x': e.x, 't': s.t + 1,
          'off': s.off + CASE WHEN s.t >= len(v) - least(7, len(v) - 1) THEN abs(e.x - s.l - s.b) ELSE 0 END,
          'naive': s.naive + CASE WHEN s.t >= len(v) - least(7, len(v) - 1) THEN abs(e.x - s.x) ELSE 0 END}}) AS s
      FROM held, grid, grid2
    ), best AS (
      SELECT *, s.off / used AS mae, s.naive / used AS naive_mae FROM tried
      QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(s.off / used, 9), alpha, beta) = 1
    )
    SELECT series, alpha, beta, round(mae, 6) AS mae, round(naive_mae, 6) AS naive_mae, step::INTEGER AS step, round(s.l + step * s.b, 6) AS forecast
    FROM best, unnest(range(1, 8)) AS r(step)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The next seven days of each kind of event, with the errors of the method and of the plain guess."""
    days = series.daily(table(spark, sf, "events"), "event_type", "ts", "value")
    return rounded(series.forecast(days, 7), 6, "mae", "naive_mae", "forecast")


@query(
    "zscore_outliers",
    """WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
    SELECT event_id, event_type AS "group", 'value' AS column_name, value, round((value - m) / s, 6) AS z
    FROM events JOIN m USING (event_type) WHERE s > 0 AND abs((value - m) / s) > 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Events far from the mean of their kind."""
    return rounded(series.zscore_outliers(table(spark, sf, "events"), "event_id", ["value"], "event_type"), 6, "z")


@query(
    "zscore_line_outliers",
    """WITH long AS (
      SELECT 'l_extendedprice' AS column_name, l_extendedprice AS value FROM lineitem
      UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem
    ), m AS (SELECT column_name, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1)
    SELECT column_name, count(*) AS outliers, min(value) AS least, max(value) AS most
    FROM long JOIN m USING (column_name) WHERE abs((value - m) / s) > 1.7 GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of order lines beyond 1.7 standard deviations, counted."""
    found = series.zscore_outliers(table(spark, sf, "lineitem"), "l_orderkey", ["l_extendedprice", "l_quantity", "l_partkey"], limit=1.7)
    return found.groupBy("column_name").agg(F.count(F.lit(1)).alias("outliers"), F.min("value").alias("least"), F.max("value").alias("most"))
