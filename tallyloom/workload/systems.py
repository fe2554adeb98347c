"""Sources, sinks, whole runs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import dashboard
from tallyloom.plans import full_analysis, pipeline, report
from tallyloom.session import scratch_path
from tallyloom.sources import files, sinks
from tallyloom.streaming import jobs
from tallyloom.workload.analysis import price_drivers
from tallyloom.workload.inputs import money, raw_log, registry, table

Q, SQL, query = registry()


# --- sources ---------------------------------------------------------------


@query(
    "csv_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as a CSV whose headers carry stray blanks, read back."""
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").withColumnsRenamed({"o_custkey": " o_custkey "}).write.option("header", True).csv(path)
    return files.csv_scan(spark, path).withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("bigint"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}
    )


@query("csv_scan_latin1", "SELECT c_custkey, concat('Zoë ', c_name) AS label FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "latin1")
    named = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Zoë "), "c_name").alias("label"))
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.csv_scan(spark, path)


@query("parquet_scan", "SELECT * FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.dataset_scan(spark, f"{sf}/supplier.parquet", None)


@query("parquet_roundtrip", "SELECT *, NULL::VARCHAR AS note FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parts")
    sinks.write_parquet(table(spark, sf, "part").withColumn("note", F.lit(None)), path)
    return files.parquet_scan(spark, path)


@query(
    "head_preview",
    """WITH h AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20), s AS (SELECT * FROM h ORDER BY o_orderkey LIMIT 5)
    SELECT 0 AS position, 'o_orderkey' AS column_name, 'integer' AS data_type, (SELECT string_agg(o_orderkey, '|' ORDER BY o_orderkey) FROM s) AS samples
    UNION ALL SELECT 1, 'o_custkey', 'integer', (SELECT string_agg(o_custkey, '|' ORDER BY o_orderkey) FROM s)
    UNION ALL SELECT 2, 'o_orderstatus', 'text', (SELECT string_agg(o_orderstatus, '|' ORDER BY o_orderkey) FROM s)
    UNION ALL SELECT 3, 'o_totalprice', 'float', (SELECT string_agg(o_totalprice, '|' ORDER BY o_orderkey) FROM s)
    UNION ALL SELECT 4, 'o_orderdate', 'datetime', (SELECT string_agg(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY o_orderkey) FROM s)
    UNION ALL SELECT 5, 'o_orderpriority', 'text', (SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM s)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, notes = files.head_preview(table(spark, sf, "orders"), 20, "o_orderkey")
    return notes.select("position", "column_name", "data_type", F.array_join("sample_values", "|").alias("samples"))


@query(
    "preview_json",
    """SELECT c_custkey AS key, concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_nationkey":', c_nationkey,
              ',"c_acctbal":', c_acctbal, ',"c_mktsegment":"', c_mktsegment, '"}') AS json
       FROM customer ORDER BY c_custkey LIMIT 20""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.preview_json(table(spark, sf, "customer"), "c_custkey")


@query(
    "duplicate_files",
    """WITH h AS (SELECT source, doc_id, sha256(text) AS hash FROM documents)
    SELECT *, count(*) OVER (PARTITION BY source, hash) AS copies, min(doc_id) OVER (PARTITION BY source, hash) AS first_key,
           doc_id <> min(doc_id) OVER (PARTITION BY source, hash) AS is_duplicate FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    return files.flag_duplicates(hashed, "source", "hash", "doc_id")


@query(
    "known_uploads",
    """SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND EXISTS (
         SELECT 1 FROM documents s WHERE s.doc_id % 2 = 0 AND s.lang = d.lang AND s.text = d.text)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("hash"))
    uploads, stored = hashed.where("doc_id % 2 = 1"), hashed.where("doc_id % 2 = 0")
    return files.already_stored(uploads, stored, "lang", "hash").select("doc_id")


@query("file_hashes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_hashes(spark, sf)


@query("storage_usage")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.storage_usage(spark, sf, quota_bytes=100 * files.MEGABYTE)


# --- sinks -----------------------------------------------------------------


@query(
    "result_sink",
    """SELECT 'by_status' AS dataset_id, o_orderstatus AS label, count(*) AS count FROM orders GROUP BY 2
       UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two datasets are stored; one is stored again and replaced, the other stays."""
    path, orders = scratch_path(spark, "results"), table(spark, sf, "orders")
    sinks.write_results(dashboard.value_shares(orders, "o_orderpriority", 2).drop("percentage"), path, "by_priority")
    sinks.write_results(dashboard.chart_category(orders, "o_orderstatus"), path, "by_status")
    sinks.write_results(dashboard.chart_category(orders, "o_orderpriority"), path, "by_priority")
    return sinks.read_results(spark, path)


# --- whole runs ------------------------------------------------------------


@query("run_pipeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the raw log, scored, clustered and named."""
    return pipeline.run_pipeline(raw_log(spark, sf)).rfm


_known: dict[tuple[str, str], full_analysis.Ingested] = {}


def parts_known(spark: SparkSession, sf: str) -> full_analysis.Ingested:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _known:
        parts = table(spark, sf, "part").withColumn("p_retailprice", money("p_retailprice"))
        _known[key] = full_analysis.ingest(parts, "part", "p_partkey")
    return _known[key]


@query(
    "ingest_summary",
    """SELECT 'part' AS dataset_id, count(*) AS row_count, 6 AS column_count, 0.0::DOUBLE AS missing_pct,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS duplicate_rows FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    summary = full_analysis.ingest_summary(parts_known(spark, sf))
    return summary.select("dataset_id", "row_count", "column_count", "missing_pct", "duplicate_rows")


@query(
    "full_analysis",
    """SELECT unnest(['eda', 'statistics', 'clustering', 'ml', 'charts', 'insights']) AS module, 'completed' AS status
       WHERE (SELECT count(*) FROM part) >= 15""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("p_retailprice", money("p_retailprice"))
    return full_analysis.run_full_analysis(
        parts,
        "part",
        "p_partkey",
        scratch_path(spark, "analysis"),
        target="p_retailprice",
        ingested=parts_known(spark, sf),
    ).select("module", "status")


@query(
    "report_doc",
    """SELECT 'part — Executive Summary' AS name, count(*) AS rows, 6 AS columns, 0.0::DOUBLE AS missing_pct,
              'p_partkey,p_size,p_retailprice' AS numeric_columns FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    known = parts_known(spark, sf)
    document = report.report_doc(
        "part",
        known.quality,
        known.classification,
        known.roles,
        known.insights,
        known.recommendations,
        price_drivers(spark, sf).features,
    )
    path = scratch_path(spark, "report")
    sinks.write_report(document, path)
    return spark.read.json(path).select(
        "name",
        F.col("dataset_overview.rows").alias("rows"),
        F.col("dataset_overview.columns").alias("columns"),
        F.col("data_quality.missing_pct").alias("missing_pct"),
        F.array_join("eda.numeric_columns", ",").alias("numeric_columns"),
    )


# --- streams ---------------------------------------------------------------


@query(
    "stream_profile",
    """SELECT 'event_id' AS column_name, 'integer' AS kind, count(*) AS row_count, count(*) - count(event_id) AS missing_count,
              min(event_id)::DOUBLE AS min, max(event_id)::DOUBLE AS max, round(sum(event_id)::DOUBLE / count(event_id), 6) AS mean FROM events
       UNION ALL SELECT 'ts', 'datetime', count(*), count(*) - count(ts), NULL, NULL, NULL FROM events
       UNION ALL SELECT 'user_id', 'integer', count(*), count(*) - count(user_id), min(user_id), max(user_id),
                        round(sum(user_id)::DOUBLE / count(user_id), 6) FROM events
       UNION ALL SELECT 'event_type', 'string', count(*), count(*) - count(event_type), NULL, NULL, NULL FROM events
       UNION ALL SELECT 'value', 'float', count(*), count(*) - count(value), min(value), max(value),
                        round(sum(value) / count(value), 6) FROM events
       UNION ALL SELECT 'props', 'string', count(*), count(*) - count(props), NULL, NULL, NULL FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema, target = table(spark, sf, "events").schema, scratch_path(spark, "stream-profile")
    jobs.profile_stream(spark, f"{sf}/events*.parquet", schema, target).awaitTermination()
    return spark.read.parquet(target).withColumn("mean", F.round("mean", 6))


SESSIONS = """marked AS (
      SELECT *, ts - lag(ts) OVER w >= INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    ), numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM marked),
    sessions AS (
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS rows, round(sum(value), 4) AS amount
      FROM numbered GROUP BY user_id, n
    )"""


SESSION_ROWS = """SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime("end", '%Y-%m-%d %H:%M:%S.%f') AS "end",
    rows, amount FROM sessions"""


def shown(found: DataFrame) -> DataFrame:
    times = {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") for name in ("start", "end")}
    return found.withColumns(times | {"amount": F.round("amount", 4)})


@query("user_sessions", f"WITH {SESSIONS} {SESSION_ROWS}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in sessions with pauses of less than six hours."""
    return shown(jobs.sessions(table(spark, sf, "events"), "ts", "user_id", "value", "6 hours"))


@query(
    "stream_sessions",
    f"""WITH {SESSIONS} {SESSION_ROWS}
    WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream: the sessions that have closed by the time of the newest event."""
    schema, target = table(spark, sf, "events").schema, scratch_path(spark, "stream-sessions")
    jobs.session_stream(spark, f"{sf}/events*.parquet", schema, target, "ts", "user_id", "value", "6 hours").awaitTermination()
    return shown(spark.read.parquet(target))


@query(
    "stream_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS rows,
              round(sum(value), 4) AS amount FROM events GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema, target = table(spark, sf, "events").schema, scratch_path(spark, "stream-daily")
    # The files cover a month and may arrive in any order.
    stream = jobs.daily_stream(
        spark, f"{sf}/events*.parquet", schema, target, "ts", "value", "event_type", late="60 days"
    )
    stream.awaitTermination()
    return jobs.daily_table(spark, target, "event_type").withColumns(
        {"day": F.date_format("day", "yyyy-MM-dd"), "amount": F.round("amount", 4)}
    )


