from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from tallyloom.operators import profile


@pytest.fixture(scope="module")
def messy(spark):
    day = dt.datetime(2025, 1, 1)
    data = [
        (i, float(i) if i % 5 else None, "a" if i % 3 else "b", day + dt.timedelta(days=i), True, "x", f"2025-01-{1 + i % 28:02d}", "y" * (40 + i % 4))
        for i in range(40)
    ]
    data += [data[1], data[1], (99, float("nan"), None, None, None, "x", "junk", None), (100, 5000.0, "a", day, True, "x", "2025-01-01", "z" * 50)]
    return spark.createDataFrame(
        data,
        "row_id long, amount double, kind string, at timestamp, flag boolean, fixed string, day_text string, note string",
    )


@pytest.fixture(scope="module")
def profiled(messy):
    return {r["column_name"]: r for r in rows(profile.profile_tables({"t": messy}))}


def test_types(profiled):
    assert {c: r["data_type"] for c, r in profiled.items()} == {
        "row_id": "integer",
        "amount": "float",
        "kind": "categorical",
        "at": "datetime",
        "flag": "boolean",
        "fixed": "categorical",
        "day_text": "datetime",
        "note": "text",
    }


def test_numeric_facts_match_pandas(messy, profiled):
    values = messy.toPandas()["amount"].dropna()
    got = profiled["amount"]
    assert got["missing_count"] == 9 and got["unique_count"] == values.nunique()
    assert got["mean"] == pytest.approx(values.mean()) and got["std"] == pytest.approx(values.std())
    assert [got[q] for q in ("q25", "median", "q75")] == pytest.approx(values.quantile([0.25, 0.5, 0.75]).tolist())
    q1, q3 = values.quantile(0.25), values.quantile(0.75)
    fence = 1.5 * (q3 - q1)
    assert got["outlier_count"] == ((values < q1 - fence) | (values > q3 + fence)).sum() == 1


def test_other_facts(profiled):
    assert profiled["kind"]["top_values"] == [{"value": "a", "rows": 29}, {"value": "b", "rows": 14}]
    assert profiled["at"]["range_days"] == 39
    assert profiled["day_text"]["range_days"] == 27
    assert (profiled["note"]["min_length"], profiled["note"]["max_length"]) == (40, 50)
    assert profiled["note"]["unique_count"] == 5 and profiled["note"]["top_values"] is None
    assert profiled["flag"]["unique_count"] == 1


def test_semantic_types(spark):
    cases = [
        ("customer_id", "integer", 900, "id"),
        ("customer_id", "integer", 12, "integer"),
        ("casino", "categorical", 100, "id"),
        ("unit_price", "float", 500, "monetary"),
        ("price_note", "categorical", 3, "categorical"),
        ("qty", "integer", 9, "quantity"),
        ("overtime", "categorical", 2, "datetime"),
        ("joined", "datetime", 400, "datetime"),
        ("gender", "categorical", 2, "boolean"),
        ("score", "integer", 5, "categorical"),
        ("body", "text", 800, "text"),
        ("churn_risk", "float", 800, "target_candidate"),
        ("height", "float", 800, "float"),
    ]
    df = spark.createDataFrame(
        [(n, t, u, 1000, None, want) for n, t, u, want in cases],
        "column_name string, data_type string, unique_count long, row_count long, avg_length double, want string",
    )
    for r in df.withColumn("got", profile.semantic_type()).collect():
        # a small distinct count makes "customer_id" an ordinary category
        want = "categorical" if (r.column_name, r.unique_count) == ("customer_id", 12) else r.want
        assert r.got == want, r.column_name


def test_duplicates_count_beyond_the_first(messy):
    assert rows(profile.duplicate_rows(messy)) == [{"duplicate_rows": 2}]
    assert rows(profile.duplicate_rows(messy.where("false"))) == [{"duplicate_rows": 0}]


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert rows(profile.duplicate_rows(df)) == [{"duplicate_rows": 1}]


def test_quality_score(messy):
    tables = {"t": messy}
    (score,) = rows(profile.quality_scores(profile.profile_tables(tables), profile.catalog_duplicates(tables)))
    missing = 100 * score["missing_cells"] / (44 * 8)
    want = 100 - min(missing * 1.5, 30) - min(2 / 44 * 100 * 2, 20) - 2 * 5 - min(3 / 44 * 10, 15)
    assert score["missing_cells"] == 13
    assert score["quality_score"] == pytest.approx(want)
    assert score["constant_columns"] == ["flag", "fixed"]
    assert score["issues"][1] == "2 duplicate rows detected (4.5%)."
    assert len(score["issues"]) == len(score["recommendations"]) == 4


def test_light_profile(messy):
    light = {r["column_name"]: r for r in rows(profile.profile_light(messy, "t"))}
    assert light["amount"]["data_type"] == "float" and light["amount"]["semantic_type"] == "monetary"
    assert light["kind"]["data_type"] == "text" and light["kind"]["missing_count"] == 1
    (q,) = rows(profile.light_quality(profile.profile_light(messy, "t")))
    assert q["quality_score"] == pytest.approx(100 - q["missing_pct"] * 1.5)


def test_samples_follow_the_key(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (9, "z")], "k int, v string")
    got = [(r["column_name"], r["value"]) for r in rows(profile.sample_values(df, "k", 2), "column_name", "place")]
    assert got == [("k", "1"), ("k", "2"), ("v", "b"), ("v", "c")]


def test_table_size(spark):
    df = spark.createDataFrame([(1, "é", 2.0, None)], "a int, b string, c double, d string")
    assert rows(profile.table_size(df))[0]["bytes"] == 4 + 2 + 8


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"v": rng.normal(size=500), "w": rng.integers(0, 4, 500)})
    one = rows(profile.profile_tables({"t": spark.createDataFrame(data).coalesce(1)}), "column_name")
    many = rows(profile.profile_tables({"t": spark.createDataFrame(data).repartition(9)}), "column_name")
    for a, b in zip(one, many):
        assert {k: v for k, v in a.items() if k not in ("mean", "std")} == {k: v for k, v in b.items() if k not in ("mean", "std")}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`it's 5` int, `a.b` string")
    got = {r["column_name"]: r for r in rows(profile.profile_tables({"t": df}))}
    assert got["it's 5"]["max"] == 2.0 and got["a.b"]["unique_count"] == 2


def test_duplicates_by_typed_hash(spark):
    """Nulls in other columns, NaN, nested nulls and texts that look like numbers are told apart as before."""
    rows = [
        (1, None, "a", [1, None], 1.5),
        (1, "a", None, [1, None], 1.5),
        (1, None, "a", [None, 1], 1.5),
        (1, None, "a", [1, None], 1.5),
        (2, "1", "2", None, float("nan")),
        (2, "1", "2", None, None),
        (2, "12", "", None, None),
        (2, "1", "2", None, float("nan")),
    ]
    df = spark.createDataFrame(rows, "k int, s string, t string, v array<int>, x double").repartition(3)
    assert profile.duplicate_rows(df).head()[0] == 3
    assert profile.duplicate_rows(df.limit(0)).head()[0] == 0


def test_duplicates_shuffle_hashes_only(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS long_text")
    plan = profile.duplicate_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("GROUP") :] if "GROUP" in plan else plan
    assert "Aggregate [_h1" in grouped and profile.duplicate_rows(df).head()[0] == 0


def test_duplicates_leave_whole_rows_in_place(spark, monkeypatch):
    """Rows were shuffled and sorted whole to look up their hashes, also where none repeats."""
    df = spark.range(1000).selectExpr("id % 700 AS k", "nullif(id % 7, 3) AS v", "repeat('x', 100) AS long_text").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = profile.duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    for slots in (1 << 20, 64, 1):
        monkeypatch.setattr(profile, "DUPLICATE_SLOTS", slots)
        assert rows(profile.duplicate_rows(df)) == [{"duplicate_rows": 300}]


def test_values_are_counted_as_they_are(spark):
    """Numbers and times make no text, which was shuffled with each of them; neighbouring large integers stay apart."""
    df = spark.sql(
        """SELECT * FROM VALUES (9007199254740992L, 1.50BD, 2.5D, TIMESTAMP'2024-01-02 03:04:05', true, 'a', 1S),
             (9007199254740993L, 1.50BD, double('NaN'), TIMESTAMP'2024-01-02 03:04:05', true, 'a', 2S),
             (9007199254740993L, NULL, -0.0D, NULL, false, 'b', 2S), (NULL, 2.00BD, 0.0D, NULL, NULL, NULL, 2S)
           AS t(`big id`, dec, dbl, at, flag, kind, small)"""
    )
    values = profile.value_table({"t": df}, profile.catalog_facts({"t": df}))
    found = {(r["column_name"], r["text"], r["number"], r["rows"]) for r in values.collect()}
    assert found == {
        ("big id", None, 9007199254740992.0, 1),  # ...993 as a double
        ("big id", None, 9007199254740992.0, 2),
        ("dec", None, 1.5, 2),
        ("dec", None, 2.0, 1),
        ("dbl", None, 2.5, 1),
        ("dbl", None, 0.0, 2),
        ("at", None, None, 2),
        ("flag", "true", None, 2),
        ("flag", "false", None, 1),
        ("kind", "a", None, 2),
        ("kind", "b", None, 1),
        ("small", None, 1.0, 1),
        ("small", None, 2.0, 3),
    }
