"""Structured Streaming forms of the light profile, the revenue trend and sessions.

All keep small state only: a row per column, per open day and group, or per open session. Results
and progress go to folders that all executors share; a stream that is started again for the
same folder reads new files only. Updates of days are merged into a base at each start, so that
reading them costs the same after many batches as after few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.exprs import quoted
from tallyloom.operators.profile import NUMERIC_TYPES, cell_sql, kind_of


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress_path(target: str) -> str:
    """Where a stream keeps its progress and state: beside its results, so that the next
    start goes on where the last one ended and batch numbers never start again."""
    return f"{target.rstrip('/')}-progress"


def _rewrite(result: DataFrame, target: str) -> StreamingQuery:
    """Process everything available, rewriting the whole small result at each trigger."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return (
        result.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", progress_path(target))
        .trigger(availableNow=True)
        .start()
    )


def _updates(result: DataFrame, target: str) -> StreamingQuery:
    """Process everything available, storing the rows each trigger changed under its
    batch number. A repeated batch overwrites itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        result.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", progress_path(target))
        .trigger(availableNow=True)
        .start()
    )


def running_profile(stream: DataFrame) -> DataFrame:
    """(column_name, kind, row_count, missing_count, min, max, mean) so far."""
    records = []
    for field in stream.schema.fields:
        value = cell_sql(field)
        number = f"cast({value} AS double)" if kind_of(field) in NUMERIC_TYPES else "cast(NULL AS double)"
        name = field.name.replace("\\", "\\\\").replace("'", "\\'")
        records.append(
            f"struct('{name}' AS column_name, '{kind_of(field)}' AS kind, {value} IS NULL AS missing, {number} AS number)"
        )
    cells = stream.selectExpr(f"inline(array({', '.join(records)}))")
    return cells.groupBy("column_name", "kind").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("missing").alias("missing_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.avg("number").alias("mean"),
    )


def daily_totals(stream: DataFrame, when: str, amount: str, by: str, late: str = "1 day") -> DataFrame:
    """Rows and summed amount per day and group. A day's state is dropped, and rows for
    it are ignored, once the newest row is ``late`` past its end."""
    timed = stream.withColumn("_at", F.col(quoted(when)).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day").alias("day"), F.col(by)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount")
    )


def profile_stream(spark: SparkSession, path: str, schema: T.StructType, target: str) -> StreamingQuery:
    return _rewrite(running_profile(file_stream(spark, path, schema)), target)


def daily_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    target: str,
    when: str,
    amount: str,
    by: str,
    late: str = "1 day",
) -> StreamingQuery:
    merge_updates(spark, target, by)
    totals = daily_totals(file_stream(spark, path, schema), when, amount, by, late)
    flat = totals.select(F.col("day.start").alias("day"), by, "rows", "amount")
    return _updates(flat, target)


def base_path(target: str) -> str:
    """Where merged updates are kept, beside the newer ones."""
    return f"{target.rstrip('/')}-base"


def _numbered(spark: SparkSession, folder: str, name: str, complete: bool = False) -> list[int]:
    """The numbers of the subfolders ``name=<number>``, in order; only completely written ones if asked for."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(conf)
    if not files.exists(place):
        return []
    found = [status.getPath() for status in files.listStatus(place) if status.getPath().getName().startswith(f"{name}=")]
    found = [p for p in found if not complete or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in found)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(conf).delete(place, True)


def _latest(spark: SparkSession, target: str, by: str, last: int | None = None) -> DataFrame | None:
    """(day, group, rows, amount, batch): the latest update of each, from the base and the batches after it up to ``last``."""
    bases = _numbered(spark, base_path(target), "upto", complete=True)
    merged = bases[-1] if bases else -1
    parts = [spark.read.parquet(f"{base_path(target)}/upto={merged}")] if bases else []
    for n in _numbered(spark, target, "batch", complete=True):
        if n > merged and (last is None or n <= last):
            parts.append(spark.read.parquet(f"{target}/batch={n}").withColumn("batch", F.lit(n)))
    if not parts:
        return None
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    latest = F.max_by(F.struct("rows", "amount", "batch"), "batch")
    return stored.groupBy("day", by).agg(latest.alias("now")).select("day", by, "now.*")


def merge_updates(spark: SparkSession, target: str, by: str) -> None:
    """Merge all batches but the last, which a start may run again, into a new base, and delete what it replaces.

    A base counts once it is complete, and batches count only above it, so that an end at any point loses nothing.
    """
    closed = _numbered(spark, target, "batch", complete=True)[:-1]
    if not closed:
        return
    last = closed[-1]
    _latest(spark, target, by, last).write.mode("overwrite").parquet(f"{base_path(target)}/upto={last}")
    for n in _numbered(spark, base_path(target), "upto"):
        if n < last:
            _delete(spark, f"{base_path(target)}/upto={n}")
    for n in closed:
        _delete(spark, f"{target}/batch={n}")


def daily_table(spark: SparkSession, target: str, by: str) -> DataFrame:
    """The current totals: the latest update of each day and group."""
    return _latest(spark, target, by).drop("batch")


def sessions(rows: DataFrame, when: str, key: str, amount: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, rows, amount) of each session: rows of a key of which each comes less than ``gap`` after the one before.

    ``end`` is ``gap`` after the last row. On a stream, open sessions are the state; one is closed, and rows for it are
    ignored, once the newest row is ``late`` past its end.
    """
    timed = rows.withColumn("_at", F.col(quoted(when)).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark("_at", late)
    else:
        timed = timed.where(F.col("_at").isNotNull())
    found = timed.groupBy(F.session_window("_at", gap).alias("session"), F.col(key)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount")
    )
    return found.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "rows", "amount")


def session_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    target: str,
    when: str,
    key: str,
    amount: str,
    gap: str,
    late: str = "1 day",
) -> StreamingQuery:
    """Process everything available and append the sessions that have closed, each once."""
    closed = sessions(file_stream(spark, path, schema), when, key, amount, gap, late)
    return (
        closed.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress_path(target))
        .trigger(availableNow=True)
        .start()
    )
