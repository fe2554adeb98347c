from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_rfm import NAMES, shop

from tallyloom.operators import rfm
from tallyloom.plans import full_analysis, pipeline, report
from tallyloom.sources import sinks


def test_pipeline(spark):
    result = pipeline.run_pipeline(spark.createDataFrame(shop(), NAMES), restarts=1)
    assert result.success and result.rfm.count() == 30 and result.clustering.k >= 2
    labels = {r.segment_label for r in result.rfm.select("segment_label").distinct().collect()}
    assert labels <= set(rfm.SEGMENTS) | {f"Segment {i}" for i in range(8)}
    assert result.orders.count() == len(shop()) - 2 and result.customer_country.count() == 30
    assert rows(result.clean_stats)[0]["not_positive_rows"] == 2


def test_pipeline_refuses_bad_input(spark):
    assert pipeline.run_pipeline(spark.createDataFrame([(1,)], "customer int")).errors[0] == "Missing required column: invoice"
    dirty = spark.createDataFrame(shop()[-2:], NAMES)
    assert pipeline.run_pipeline(dirty).errors == ["No valid rows after cleaning"]


def test_few_customers_form_one_cluster(spark):
    result = pipeline.run_pipeline(spark.createDataFrame(shop(6), NAMES))
    assert {(r.cluster, r.segment_label) for r in result.rfm.collect()} == {(0, rfm.POTENTIAL)}


@pytest.fixture(scope="module")
def staff(spark):
    return spark.range(80).select(
        F.col("id").alias("employee_id"),
        F.element_at(F.array(*[F.lit(d) for d in ("IT", "HR", "Ops")]), (F.col("id") % 3 + 1).cast("int")).alias("department"),
        (1000 + F.col("id") * 7 % 50 * 100).alias("salary"),
        (F.col("id") % 4 + 1).alias("performance_rating"),
        F.when(F.col("id") % 5 == 0, "Yes").otherwise("No").alias("attrition"),
    )


def test_full_analysis_isolates_failures(spark, staff, tmp_path, monkeypatch):
    known = full_analysis.ingest(staff, "staff", "employee_id")
    (summary,) = rows(full_analysis.ingest_summary(known))
    assert summary["row_count"] == 80 and summary["dataset_type"] == "hr"

    def broken(*_, **__):
        raise RuntimeError("no clusters today")

    monkeypatch.setattr(full_analysis.clustering, "cluster_table", broken)
    path = str(tmp_path)
    status = {
        r["module"]: r
        for r in rows(
            full_analysis.run_full_analysis(staff, "staff", "employee_id", path, ingested=known, trees=5, boosts=3)
        )
    }
    assert status["clustering"]["status"] == "failed" and "no clusters today" in status["clustering"]["message"]
    assert {m for m, r in status.items() if r["status"] == "completed"} == {"eda", "statistics", "ml", "charts", "insights"}, status
    assert status["ml"]["message"].endswith("for attrition")
    assert sinks.read_results(spark, f"{path}/model_metrics").count() == 15
    assert sinks.read_results(spark, f"{path}/columns").count() == 5


def test_report(spark, staff, tmp_path):
    known = full_analysis.ingest(staff, "staff", "employee_id")
    document = report.report_doc(
        "staff", known.quality, known.classification, known.roles, known.insights, known.recommendations, kind="full"
    )
    sinks.write_report(document, str(tmp_path / "r"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    body = json.loads(line)
    assert body["name"] == "staff — Comprehensive Analysis Report"
    assert body["dataset_overview"]["rows"] == 80 and body["dataset_overview"]["dataset_type"] == "hr"
    assert body["eda"]["numeric_columns"] == ["employee_id", "salary", "performance_rating"]
    assert len(body["limitations"]) == 3


def test_train_catalog(spark, staff, tmp_path):
    tables = {"staff": (staff, "employee_id"), "tiny": (staff.limit(3), "employee_id")}
    got = {r["dataset_id"]: r for r in rows(full_analysis.train_catalog(tables, str(tmp_path), trees=5, boosts=3))}
    assert got["staff"]["status"] == "completed" and got["tiny"]["status"] == "failed"
