"""Writing tables, result sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def storable(df: DataFrame) -> DataFrame:
    """Columns that Parquet cannot hold (void, intervals) as strings."""
    odd = (T.NullType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, odd)})


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    storable(df).write.mode(mode).parquet(path)


def write_results(df: DataFrame, path: str, dataset_id: str | None = None) -> None:
    """Store result rows by dataset. A dataset's earlier rows are replaced, those of
    other datasets stay."""
    if dataset_id is not None:
        df = df.withColumn("dataset_id", F.lit(dataset_id))
    (
        storable(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("dataset_id", F.col("dataset_id").cast("string"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per dataset."""
    report.write.mode("overwrite").json(path)
