"""Whole-table runs: the first look at a new dataset, and the full set of modules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import numeric_columns, text_columns
from tallyloom.functions.exprs import one_row
from tallyloom.operators import catalog, clustering, dashboard, insights, profile, stats, supervised
from tallyloom.sources.files import preview_json
from tallyloom.session import scratch_scope
from tallyloom.sources.sinks import write_results


@dataclass
class Ingested:
    """What is known of a dataset once it has been read."""

    dataset_id: str
    preview: DataFrame
    profile: DataFrame
    quality: DataFrame
    classification: DataFrame
    roles: DataFrame
    plan: DataFrame
    insights: DataFrame
    recommendations: DataFrame


def ingest(df: DataFrame, dataset_id: str, key: str) -> Ingested:
    """Preview, profile, quality, domain, plan and first insights of a dataset."""
    profiled = profile.profile_tables({dataset_id: df})
    quality = profile.quality_scores(profiled, profile.catalog_duplicates({dataset_id: df}))
    roles = catalog.dataset_roles(profiled)
    found, advice = insights.table_insights(df, profiled, dataset_id)
    return Ingested(
        dataset_id,
        preview_json(df, key),
        profiled,
        quality,
        catalog.classify_datasets(profiled),
        roles,
        catalog.capability_plan(roles),
        found,
        advice,
    )


def ingest_summary(ingested: Ingested) -> DataFrame:
    """One row: size, score, domain, number of possible analyses and findings."""
    available = ingested.plan.where((F.col("section") == "feature") & F.col("available"))
    domain = one_row(ingested.classification)
    return ingested.quality.select(
        "dataset_id",
        "row_count",
        "column_count",
        "missing_pct",
        "duplicate_rows",
        "quality_score",
        domain["dataset_type"].alias("dataset_type"),
        domain["confidence"].alias("confidence"),
        available.agg(F.count(F.lit(1))).scalar().alias("available_features"),
        ingested.insights.agg(F.count(F.lit(1))).scalar().alias("insights"),
    )


MODULES = ["eda", "statistics", "clustering", "ml", "charts", "insights"]
STATUS = "module string, status string, message string"


def run_full_analysis(
    df: DataFrame,
    dataset_id: str,
    key: str,
    output: str,
    modules: Sequence[str] = MODULES,
    target: str | None = None,
    ingested: Ingested | None = None,
    n_clusters: int | None = None,
    restarts: int = 10,
    trees: int = 100,
    boosts: int = 80,
) -> DataFrame:
    """Run the chosen modules, store each result under ``output`` by dataset, and
    return (module, status, message). A module that cannot run does not stop others."""
    spark: SparkSession = df.sparkSession
    known = ingested or ingest(df, dataset_id, key)
    mine = known.profile.where(F.col("dataset_id") == dataset_id)
    columns = mine.orderBy("position").collect()
    distinct = {r["column_name"]: r["unique_count"] for r in columns}
    measures = [c for c in numeric_columns(df) if c != key]
    categories = [r["column_name"] for r in columns if r["data_type"] in ("categorical", "boolean")]
    dates = [r["column_name"] for r in columns if r["data_type"] == "datetime" or "date" in r["column_name"].lower()]

    def store(frame: DataFrame, name: str) -> None:
        write_results(frame, f"{output}/{name}", dataset_id)

    def eda() -> str:
        store(mine.drop("dataset_id"), "columns")
        store(known.quality.drop("dataset_id"), "quality")
        return f"{len(columns)} columns"

    def statistics() -> str:
        if len(measures) < 2:
            return "skipped: fewer than two measures"
        store(stats.correlation_matrix(stats.correlation_pairs(df, measures)), "correlations")
        found = stats.statistical_tests(df.select(*measures, *text_columns(df)), distinct)
        if found is not None:
            store(found, "tests")
        return f"{len(measures)} measures"

    def cluster() -> str:
        result = clustering.cluster_table(df, key, n_clusters=n_clusters, restarts=restarts)
        store(clustering.cluster_summary(result), "clusters")
        store(clustering.curve_table(result), "elbow_curve")
        store(clustering.scatter_sample(result, key), "scatter")
        return f"{result.k} clusters"

    def learn() -> str:
        names = [c for c in df.columns if c != key]
        goal = target or supervised.detect_target(names, measures, distinct)
        features = [
            r["column_name"]
            for r in supervised.predictor_columns(mine, goal).orderBy("position").collect()
            if r["column_name"] != key and r["data_type"] != "datetime"
        ]
        best = supervised.compare_models(df, key, goal, features, trees=trees, boosts=boosts)
        store(supervised.metrics_long(best.leaderboard), "model_metrics")
        drivers = supervised.feature_importance(df, key, goal, features, distinct, trees=trees)
        store(drivers.features, "importance")
        store(supervised.driver_report(drivers.features), "drivers")
        relations = supervised.driver_relationships(df, drivers)
        if relations is not None:
            store(relations, "driver_relationships")
        return f"{best.best_model} for {goal}"

    def charts() -> str:
        drawn = 0
        if categories:
            store(dashboard.chart_category(df, categories[0]), "chart_category")
            drawn += 1
        if dates and measures:
            store(dashboard.chart_trend(df, dates[0], measures[0]), "chart_trend")
            drawn += 1
        if measures:
            store(dashboard.histogram(df, measures[0]), "chart_histogram")
            drawn += 1
        return f"{drawn} charts"

    def findings() -> str:
        store(known.insights, "insights")
        store(known.recommendations, "recommendations")
        return "stored"

    steps = {
        "eda": eda,
        "statistics": statistics,
        "clustering": cluster,
        "ml": learn,
        "charts": charts,
        "insights": findings,
    }
    status = []
    for name in modules:
        try:
            with scratch_scope(spark):
                message = steps[name]()
            state = "skipped" if message.startswith("skipped") else "completed"
        except Exception as error:  # one module's failure is reported, not raised
            state, message = "failed", f"{type(error).__name__}: {error}"
        status.append((name, state, message))
    return spark.createDataFrame(status, STATUS)


def train_catalog(
    tables: dict[str, tuple[DataFrame, str]], output: str, trees: int = 100, boosts: int = 80
) -> DataFrame:
    """Train models for every table of a catalog on its best target.

    ``tables`` maps a dataset to (frame, key). Training is distributed; the loop is
    over datasets.
    """
    status = []
    spark = next(iter(tables.values()))[0].sparkSession
    for dataset_id, (df, key) in tables.items():
        try:
            goal = supervised.pick_batch_target([c for c in df.columns if c != key])
            with scratch_scope(spark):
                best = supervised.compare_models(df, key, goal, trees=trees, boosts=boosts)
                write_results(supervised.metrics_long(best.leaderboard), f"{output}/model_metrics", dataset_id)
            status.append((dataset_id, "completed", f"{best.best_model} for {goal}"))
        except Exception as error:  # report and train the next dataset
            status.append((dataset_id, "failed", f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(status, "dataset_id string, status string, message string")
