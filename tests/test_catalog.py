from __future__ import annotations

import pytest
from conftest import rows

from tallyloom.operators import catalog

# dataset -> (rows, columns as name:data_type:semantic_type)
TABLES = {
    "sales": (200, "deal_id:categorical:id sales_rep:categorical:categorical region:categorical:categorical "
              "stage:categorical:categorical deal_amount:float:monetary profit:float:float discount_pct:float:float "
              "closed_date:datetime:datetime"),
    "hr": (250, "employee_id:categorical:id department:categorical:categorical job_role:categorical:categorical "
           "monthly_income:integer:monetary years_at_company:integer:datetime performance_rating:integer:categorical "
           "overtime:categorical:datetime attrition:categorical:boolean"),
    "shop": (700, "invoice_no:categorical:id customer_id:categorical:id description:categorical:categorical "
             "quantity:integer:quantity unit_price:float:monetary total_amount:float:monetary "
             "invoice_date:datetime:datetime country:categorical:categorical"),
    "series": (300, "timestamp:datetime:datetime power_kwh:float:float voltage:float:float ambient_temp_c:float:float"),
    "poll": (150, "respondent_id:categorical:id satisfaction_score:integer:categorical nps_rating:integer:categorical "
             "q_ease:integer:categorical quality:integer:categorical comments:text:text"),
    "plain": (5, "a:float:float b:categorical:categorical"),
}


@pytest.fixture(scope="module")
def profiled(spark):
    data = []
    for name, (count, columns) in TABLES.items():
        for i, c in enumerate(columns.split()):
            column, kind, meaning = c.split(":")
            data.append((name, i, column, kind, meaning, count, 10))
    schema = "dataset_id string, position int, column_name string, data_type string, semantic_type string, row_count long, unique_count long"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="module")
def plan(profiled):
    found = rows(catalog.capability_plan(catalog.dataset_roles(profiled)))
    return {(r["dataset_id"], r["section"], r["key"]): r for r in found}


def test_domains(profiled):
    got = {r["dataset_id"]: r for r in rows(catalog.classify_datasets(profiled))}
    assert {d: r["dataset_type"] for d, r in got.items()} == {
        "sales": "sales",
        "hr": "hr",
        "shop": "ecommerce",
        "series": "time-series",
        "poll": "survey",
        "plain": "generic-tabular",
    }
    assert got["series"]["confidence"] == 85.0 and got["plain"]["confidence"] == 60.0
    assert got["plain"]["dataset_type_label"] == "General Tabular Data"
    assert got["poll"]["matched_features"] == ["satisfaction_score", "q_ease", "quality"]


def test_scores_follow_the_formula(profiled):
    got = {r["dataset_id"]: r for r in rows(catalog.classify_datasets(profiled))}
    # deal, sales, amount, profit, discount and closed_date: capped
    assert got["sales"]["confidence"] == 98.0
    assert got["sales"]["reason"] == (
        "Detected characteristic sales patterns (matched key fields: amount, closed_date, deal, discount)."
    )
    # employee, department, job_role, performance, overtime, attrition, years_at_company: capped
    assert got["hr"]["confidence"] == pytest.approx(min(7 / 8 * 1.3 * 100 + 84, 98))


def test_rfm_needs_buyer_date_and_money(plan):
    assert plan["shop", "module", "rfm"]["available"]
    for name in ("hr", "sales", "series", "plain"):
        assert not plan[name, "module", "rfm"]["available"]
    assert plan["hr", "module", "rfm"]["reason"].startswith("No customer identifier")


def test_plan_is_complete(plan):
    sections = [s for d, s, _ in plan if d == "shop"]
    assert (sections.count("feature"), sections.count("module"), sections.count("analysis")) == (14, 8, 7)
    assert plan["series", "feature", "time_series"]["reason"].endswith("using 'timestamp'.")
    assert not plan["plain", "feature", "segmentation"]["available"]
    assert not plan["plain", "feature", "ml"]["available"]
    assert plan["hr", "feature", "ml"]["reason"] == "Supervised predictive models can be benchmarked (Target: attrition)."
    assert plan["shop", "feature", "analytics"]["reason"].startswith("Active dataset loaded with 8 columns and 700 rows")
    assert plan["poll", "feature", "nlp"]["available"] and not plan["shop", "feature", "nlp"]["available"]


def test_roles(profiled):
    got = {r["dataset_id"]: r for r in rows(catalog.dataset_roles(profiled))}
    assert got["hr"]["target_column"] == "attrition" and got["hr"]["recommended_task"] == "classification"
    assert got["shop"]["entity_column"] == "customer_id" and got["shop"]["measure_column"] == "unit_price"
    assert got["shop"]["monetary_column"] == "unit_price" and got["shop"]["date_column"] == "invoice_date"
    assert got["plain"]["target_column"] == "b" and got["series"]["customer_column"] is None


def test_column_roles(profiled):
    got = {r["dataset_id"]: r for r in rows(catalog.column_roles(profiled))}
    assert got["shop"]["numeric_columns"] == ["quantity", "unit_price", "total_amount"]
    assert got["shop"]["possible_ids"] == ["invoice_no", "customer_id"]
    assert got["poll"]["text_columns"] == ["comments"] and got["hr"]["possible_targets"] == []


def test_capability_list(profiled):
    cards = rows(catalog.capability_list(catalog.capability_plan(catalog.dataset_roles(profiled))))
    assert len(cards) == 14 * len(TABLES) and {c["confidence"] for c in cards} == {0.95}
