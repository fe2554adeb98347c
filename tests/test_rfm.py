from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import rfm
from tallyloom.operators.cleaning import clean_transactions


def shop(n=30):
    lines = []
    for c in range(1, n + 1):
        for o in range(1 + c % 5):
            lines.append(
                (
                    f"5{c:03d}{o}",
                    "SKU",
                    "Mug",
                    2 * (1 + o),
                    f"2025-{1 + (c + o) % 12:02d}-{1 + c % 28:02d} 10:00:00",
                    10.5,
                    str(1000 + c),
                    "United Kingdom" if c % 3 else "Germany",
                )
            )
    lines.append(("C59999", "SKU", "Mug", -2, "2025-01-01 10:00:00", 10.5, "1001", "Germany"))
    lines.append(("59998", "SKU", "Mug", 2, "2025-01-01 10:00:00", 0.0, "1001", "Germany"))
    return lines


NAMES = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


@pytest.fixture(scope="module")
def clean(spark):
    return clean_transactions(spark.createDataFrame(shop(), NAMES))


def test_thirty_customers_with_scores_in_range(clean):
    scored = rows(rfm.rfm_scores(rfm.rfm_base(clean)), "customer_code")
    assert len(scored) == 30
    for r in scored:
        assert all(1 <= r[s] <= 5 for s in ("r_score", "f_score", "m_score"))
        assert r["rfm_score"] == r["r_score"] * 100 + r["f_score"] * 10 + r["m_score"]


def test_base_matches_pandas(clean):
    got = rfm.rfm_base(clean).toPandas().set_index("customer_code").sort_index()
    df = pd.DataFrame(shop()[:-2], columns=NAMES)
    df["at"] = pd.to_datetime(df["InvoiceDate"])
    df["total"] = df["Quantity"] * df["UnitPrice"]
    want = df.groupby("CustomerID").agg(last=("at", "max"), f=("InvoiceNo", "nunique"), m=("total", "sum"))
    ref = df["at"].max().normalize() + pd.Timedelta(days=1)
    assert (got["frequency"] == want["f"]).all()
    assert got["monetary"].tolist() == pytest.approx(want["m"].tolist())
    assert (got["recency_days"] == (ref - want["last"]).dt.days).all()


def test_scores_match_qcut(clean):
    base = rfm.rfm_base(clean)
    got = rfm.rfm_scores(base).toPandas().sort_values("customer_code")
    f = pd.qcut(got["frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    m = pd.qcut(got["monetary"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got["f_score"] == f).all() and (got["m_score"] == m).all()


def test_country_mode_and_shared_invoices(spark):
    day = dt.datetime(2025, 1, 1)
    clean = spark.createDataFrame(
        [("1", "a", day, "p", 1, 1.0, 1.0, c) for c in ("B", "A", "C", "A", "B")]
        + [("2", "a", day, "p", 1, 1.0, 1.0, "C"), ("1", "b", day, "p", 1, 1.0, 2.0, "Z")],
        "invoice string, customer string, date timestamp, product string, quantity int, price double, "
        "total_price double, country string",
    )
    got = {r["customer_code"]: r for r in rows(rfm.rfm_base(clean, dt.date(2025, 1, 11)))}
    assert got["a"]["country"] == "A" and got["a"]["frequency"] == 2 and got["a"]["monetary"] == 6.0
    assert got["b"]["frequency"] == 1 and got["b"]["recency_days"] == 10


def test_equal_recencies_do_not_fail(spark):
    base = spark.createDataFrame([(str(i), 3) for i in range(10)], "customer_code string, recency_days int")
    scores = base.select((6 - rfm.value_quintile(base, "recency_days")).alias("r"))
    assert {r.r for r in scores.collect()} == {5}


def test_rule_segments(spark):
    cases = [(5, 1, 4, rfm.VIP), (3, 4, 5, rfm.LOYAL), (3, 2, 1, rfm.POTENTIAL), (2, 3, 5, rfm.AT_RISK)]
    df = spark.createDataFrame(cases, "r_score int, f_score int, m_score int, want string")
    assert all(r.segment_label == r.want for r in rfm.rfm_segments(df).collect())


def test_generic_counts_rows_and_skips_nulls(spark):
    df = spark.createDataFrame(
        [("a", "2025-01-01", 1.0), ("a", "2025-01-05", 2.0), ("b", "2025-01-03", 5.0), ("b", "never", 9.0), (None, "2025-01-05", 1.0)],
        "who string, at string, amount double",
    )
    got = {r["customer_code"]: r for r in rows(rfm.rfm_generic(df, "who", "at", "amount"))}
    assert got["a"]["frequency"] == 2 and got["a"]["recency_days"] == 1
    assert got["b"]["frequency"] == 1 and got["b"]["recency_days"] == 3 and got["b"]["monetary"] == 5.0
    assert got["a"]["r_score"] == 5


def test_asof_leaves_out_customers_without_orders(spark):
    customers = spark.createDataFrame([(1,), (2,), (3,)], "customer_id int")
    orders = spark.createDataFrame(
        [(1, "i1", dt.date(2025, 1, 1), 5.0), (1, "i1", dt.date(2025, 1, 1), 5.0), (2, "i2", dt.date(2025, 1, 9), 1.0)],
        "customer_id int, invoice_id string, order_date date, total_price double",
    )
    got = {r["customer_id"]: r for r in rows(rfm.rfm_asof(customers, orders, dt.date(2025, 1, 10)))}
    assert set(got) == {1, 2}
    assert got[1]["frequency"] == 1 and got[1]["recency_days"] == 9
    assert (got[1]["r_score"], got[2]["r_score"]) == (1, 5)
    assert (got[1]["f_score"], got[2]["f_score"]) == (1, 1)


def test_distribution_fills_zeros(spark):
    df = spark.createDataFrame([(5, 1, 3), (5, 2, 3)], "r_score int, f_score int, m_score int")
    got = {(r.dimension, r.score): r.customers for r in rfm.score_distribution(df).collect()}
    assert len(got) == 11 and got["recency", 5] == 2 and got["recency", 1] == 0 and got["monetary", 3] == 2


def test_hot_customer(spark):
    """One customer with most rows gives the same result as pandas."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("invoice"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 50).cast("string")).alias("customer"),
        F.to_timestamp(F.lit("2025-01-01")).alias("date"),
        F.lit(1.0).alias("total_price"),
        (F.col("id") % 7).cast("string").alias("country"),
    )
    got = {r["customer_code"]: r for r in rows(rfm.customer_activity(df))}
    assert got["hot"]["frequency"] == 2000 and got["hot"]["monetary"] == 2000.0
