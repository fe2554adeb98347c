"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got = check.spark_rows(QUERIES[name](spark, SF))
    # "approx" is equality up to the last bits of interpolated quantiles.
    assert check.compare(got, check.sql_rows(con, SQL[name])).startswith(("exact", "approx"))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "segment_label" and result.count() >= 1


@pytest.mark.parametrize("name", ["rfm_scores", "customer_directory", "commerce_kpis", "kpi_summary", "pareto_share", "corr_spearman"])
def test_plans_have_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
