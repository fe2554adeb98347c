"""One JSON document per dataset from stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import one_row

# Report titles.
TITLES = {
    "summary": "Executive Summary",
    "full": "Comprehensive Analysis Report",
    "statistics": "Statistical & Correlation Audit",
    "ml": "Predictive Machine Learning Benchmark",
    "business": "Strategic Business Intelligence & Playbook",
    "features": "Feature Importance & Key Drivers Report",
}


def report_name(dataset_id: str, kind: str) -> str:
    return f"{dataset_id} — {TITLES.get(kind.lower(), kind.title() + ' Report')}"


def _rows(frame: DataFrame, columns: list[str], limit: int) -> Column:
    """A short result table as an array of structs."""
    return frame.select(*columns).limit(limit).agg(F.collect_list(F.struct(*columns))).scalar()


def _by_weight(frame: DataFrame, weight: str) -> DataFrame:
    """The weightiest first, then by title: which ten a report shows is fixed."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), F.lower(F.col(weight)))
    return frame.orderBy(F.when(place > 0, place).otherwise(4), "title")


def report_doc(
    dataset_id: str,
    quality: DataFrame,
    classification: DataFrame,
    roles: DataFrame,
    insights: DataFrame,
    recommendations: DataFrame,
    importance: DataFrame | None = None,
    kind: str = "summary",
) -> DataFrame:
    """One nested row: overview, quality, columns by type, drivers, findings, advice.

    Every input is a result table with a few rows per dataset.
    """
    mine = F.col("dataset_id") == dataset_id
    domain = one_row(classification.where(mine))
    columns = one_row(roles.where(mine).drop("dataset_id"))
    score = F.col("quality_score")
    drivers = (
        _rows(importance.orderBy("rank"), ["rank", "name", "importance", "correlation", "direction", "impact_level"], 15)
        if importance is not None
        else F.lit(None)
    )
    return quality.where(mine).select(
        F.lit(report_name(dataset_id, kind)).alias("name"),
        F.lit(kind).alias("report_type"),
        F.current_timestamp().alias("generated_at"),
        F.struct(
            F.lit(dataset_id).alias("dataset_id"),
            F.col("row_count").alias("rows"),
            F.col("column_count").alias("columns"),
            domain["dataset_type"].alias("dataset_type"),
            F.round(domain["confidence"], 1).alias("confidence"),
        ).alias("dataset_overview"),
        F.struct(
            F.round(score, 1).alias("quality_score"),
            F.round("missing_pct", 2).alias("missing_pct"),
            F.col("duplicate_rows").alias("duplicates"),
            F.col("issues").alias("warnings"),
        ).alias("data_quality"),
        F.struct(
            *[
                columns[c].alias(c)
                for c in ("numeric_columns", "categorical_columns", "datetime_columns", "text_columns")
            ]
        ).alias("eda"),
        drivers.alias("feature_importance"),
        _rows(_by_weight(insights, "priority"), ["title", "finding", "evidence", "priority"], 10).alias("insights"),
        _rows(_by_weight(recommendations, "impact"), ["title", "recommendation", "impact", "effort"], 10).alias("recommendations"),
        F.array(
            F.lit("Analysis reflects tabular distributions at upload time."),
            F.format_string("Data quality confidence rating: %.0f/100.", score),
            F.lit("Statistical tests assume random sampling from underlying population."),
        ).alias("limitations"),
    )
