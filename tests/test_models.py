from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import clustering, prep, supervised


# --- preparation -----------------------------------------------------------


def test_median_is_the_mean_of_the_middle_two(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert sorted(r.v for r in prep.impute_median(df, ["v"]).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("b", None), ("a", None)], "v string, n int")
    got = prep.impute_mode(df, ["v", "n"]).collect()
    assert sorted(r.v for r in got) == ["a", "a", "a", "b", "b"] and sorted(r.n for r in got) == [1, 1, 1, 1, 2]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted((r.a, r.b) for r in prep.zscale(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_is_stratified_and_fixed(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 < 2, "hot").otherwise("cold").alias("y"))
    first = {r.id: r.is_train for r in prep.stratified_split(df, "id", "y").collect()}
    again = {r.id: r.is_train for r in prep.stratified_split(df.repartition(7), "id", "y").collect()}
    assert first == again and len(first) == 500
    hot = [v for k, v in first.items() if k % 5 < 2]
    assert sum(hot) == 160 and sum(first.values()) == 400


def test_sample_size(spark):
    assert prep.random_rows(spark.range(50), "id", 20).count() == 20
    assert prep.random_rows(spark.range(5), "id", 20).count() == 5


# --- clustering ------------------------------------------------------------


def test_elbow_rule():
    assert clustering.elbow_k([9.0, 1.0], [0.1, 0.2]) == 2
    # second differences 70, 8, 1: position 0 counts as k = 2
    assert clustering.elbow_k([100, 20, 10, 8, 7], [0.9, 0.5, 0.4, 0.3, 0.2]) == 2
    assert clustering.elbow_k([100, 20, 10, 8, 7], [0.1, 0.2, 0.9, 0.3, 0.2]) == 4
    assert clustering.elbow_k([100, 90, 80, 70, 60, 50, 10], [0.1] * 6 + [0.9]) == 6


def test_silhouette_rule():
    curve = [{"k": 2, "silhouette": 0.4}, {"k": 3, "silhouette": 0.6}, {"k": 4, "silhouette": 0.6}]
    assert clustering.silhouette_k(curve) == 3
    assert clustering.silhouette_k(curve, 4) == 4 and clustering.silhouette_k(curve, 9) == 3
    assert clustering.silhouette_k([]) == 3


def averages(cluster, r, f, m, recency):
    return {"cluster": cluster, "avg_r": r, "avg_f": f, "avg_m": m, "avg_recency": recency}


def test_personas_are_given_once():
    labels = clustering.persona_of(
        [averages(0, 4, 4.5, 4.6, 5), averages(1, 4, 4.4, 4.5, 6), averages(2, 1, 1, 1, 90), averages(3, 3, 2, 2, 20), averages(4, 3, 2, 1, 21)]
    )
    assert labels == {
        0: "VIP Customers",
        1: "Loyal Customers",
        3: "Potential Customers",
        4: "At-Risk Customers",
        2: "Segment 2",
    }


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(120):
        c = i % 3
        data.append((i, float(rng.normal(c * 50, 1)), float(rng.normal(-c * 20, 1)), None if i == 7 else float(rng.normal(100, 1))))
    return spark.createDataFrame(data, "row_id int, spend double, visits double, level double")


@pytest.fixture(scope="module")
def clustered(blobs):
    return clustering.cluster_table(blobs, "row_id", ["spend", "visits"], max_k=4, restarts=2)


def test_blobs_are_found(clustered):
    assert clustered.k == 3 and clustered.silhouette > 0.9
    got = {r.row_id: r.cluster for r in clustered.assigned.collect()}
    for c in range(3):
        assert len({got[i] for i in range(c, 120, 3)}) == 1
    assert [c["k"] for c in clustered.curve] == [2, 3, 4]
    assert sum(clustered.explained_variance) == pytest.approx(1.0)


def test_cluster_summary_adds_up(clustered, blobs):
    got = rows(clustering.cluster_summary(clustered), "cluster")
    assert sum(r["count"] for r in got) == 120 and sum(r["percentage"] for r in got) == pytest.approx(100)
    # centres at 0, 50 and 100 around a mean of 50
    labels = sorted(r["segment_label"].split()[0] for r in got)
    assert labels == ["Balanced", "High", "Low"]
    assert len(rows(clustering.scatter_sample(clustered, "row_id", k=50))) == 50
    assert len(rows(clustering.curve_table(clustered))) == 3


def test_missing_features_are_imputed(blobs):
    result = clustering.cluster_table(blobs, "row_id", n_clusters=2, max_k=2, restarts=1)
    assert result.features == ["spend", "visits", "level"] and result.assigned.count() == 120


def test_not_a_number_is_missing(blobs):
    odd = blobs.withColumn("spend", F.when(F.col("row_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("spend")))
    got = {r.row_id: r.spend for r in prep.impute_median(odd, ["spend"]).collect()}
    nulls = blobs.withColumn("spend", F.when(F.col("row_id") % 9 != 0, F.col("spend")))
    assert got == {r.row_id: r.spend for r in prep.impute_median(nulls, ["spend"]).collect()}
    result = clustering.cluster_table(odd, "row_id", ["spend", "visits"], max_k=3, restarts=1)
    assert result.assigned.count() == 120 and result.silhouette > 0


def test_number_of_clusters_is_honoured_or_refused(blobs):
    with pytest.raises(ValueError, match="between 2 and max_k"):
        clustering.cluster_table(blobs, "row_id", ["spend", "visits"], n_clusters=9)
    result = clustering.cluster_table(blobs, "row_id", ["spend", "visits"], n_clusters=9, max_k=9, restarts=1)
    assert result.k == 9 and [c["k"] for c in result.curve] == list(range(2, 10))


def test_too_little_data(blobs):
    with pytest.raises(ValueError, match="minimum 10 rows"):
        clustering.cluster_table(blobs.limit(9), "row_id", ["spend", "visits"])
    with pytest.raises(ValueError, match="At least 2"):
        clustering.cluster_table(blobs, "row_id", ["spend"])


def test_balanced_label(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.1), (1, 1.0), (1, 0.9)], "cluster int, v double")
    got = {r.cluster: r.segment_label for r in clustering.cohort_labels(clustering.cluster_means(df, ["v"]), ["v"]).collect()}
    assert got == {0: "Balanced Tier 1", 1: "Balanced Tier 2"}


# --- supervised ------------------------------------------------------------


def test_target_choice():
    names = ["user_id", "total_paid", "rating_id", "churned", "age"]
    assert supervised.detect_target(names, ["total_paid", "age"], {}) == "churned"
    assert supervised.detect_target(["a", "b", "c_id"], ["a", "c_id"], {"a": 4}) == "a"
    assert supervised.detect_target(["a", "b"], ["a"], {"a": 1}) == "b"
    assert supervised.pick_batch_target(["order_id", "profit", "grade"]) == "grade"
    assert supervised.pick_batch_target(["order_id", "x", "order_date"]) == "x"
    assert supervised.pick_batch_target(["order_id"]) == "order_id"
    assert supervised.default_features(["id", "zipcode", "y"], "y") == ["id", "zipcode"]


def test_task_choice(spark):
    df = spark.range(20).select(F.col("id").alias("many"), (F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("word"))
    assert supervised.task_of(df, "many") == "regression"
    assert supervised.task_of(df, "few") == supervised.task_of(df, "word") == "classification"
    assert supervised.task_of(df, "few", "Regression") == "regression"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(200):
        x = float(rng.normal())
        data.append((i, x if i % 17 else None, float(rng.normal()), ["red", "blue"][i % 2], "yes" if x > 0 else "no", 3 * x + (i % 2)))
    return spark.createDataFrame(data, "row int, x double, noise double, colour string, outcome string, size double")


def test_classification_board(labelled):
    found = supervised.compare_models(labelled, "row", "outcome", ["x", "noise", "colour"], trees=10, boosts=5)
    assert found.task == "classification" and (found.train_samples, found.test_samples) == (159, 41)
    board = rows(found.leaderboard)
    assert len(board) == 3 and max(b["accuracy"] for b in board) > 85
    assert all(0 <= b["roc_auc"] <= 1 for b in board)
    long = rows(supervised.metrics_long(found.leaderboard))
    assert len(long) == 15 and {r["split"] for r in long} == {"test"}


def test_regression_board(labelled):
    found = supervised.compare_models(labelled.where("x IS NOT NULL"), "row", "size", ["x", "noise", "colour"], trees=10, boosts=5)
    board = {b["model_name"]: b for b in rows(found.leaderboard)}
    assert len(board) == 4 and board["Linear Regression"]["r2_score"] == pytest.approx(1.0)
    assert 0.99 < board["Ridge Regression"]["r2_score"] < 1.0


def test_hashing_is_chosen_by_the_caller(labelled, monkeypatch):
    encoded = supervised.encode(labelled, "row", "outcome", ["x", "colour"], "classification", hash_slots=64)
    assert len(encoded.slots) == 1 + 64 == encoded.rows.first().features.size
    monkeypatch.setattr(supervised, "MOST_LEVELS", 1)
    with pytest.raises(ValueError, match="hash_slots"):
        supervised.encode(labelled, "row", "outcome", ["x", "colour"], "classification")


def test_too_many_classes_are_refused(labelled):
    words = labelled.withColumn("word", F.concat(F.lit("w"), F.col("row")))
    with pytest.raises(ValueError, match="more than 100 classes"):
        supervised.compare_models(words, "row", "word", ["x"])


def test_unseen_categories_become_zeros(labelled):
    flagged = labelled.withColumn("is_train", F.col("colour") == "red")
    encoded = supervised.encode(flagged, "row", "outcome", ["colour"], "classification", "is_train")
    blue = encoded.rows.where("NOT is_train").first()
    assert blue.features.numNonzeros() == 0 and encoded.slots == ["colour"]


def test_too_few_rows(labelled):
    with pytest.raises(ValueError, match="minimum 15"):
        supervised.compare_models(labelled.limit(10), "row", "outcome")
    with pytest.raises(ValueError, match="not found"):
        supervised.compare_models(labelled, "row", "nothing")


def test_metrics_match_their_formulas(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 2 + [(2.0, 0.0)], "label double, prediction double")
    (m,) = rows(supervised.classification_metrics(df))
    assert m["accuracy"] == 0.7 and m["recall"] == pytest.approx(0.7)
    assert m["precision"] == pytest.approx((7 * 5 / 6 + 2 * 0.5) / 10)
    (r,) = rows(supervised.regression_metrics(df))
    assert r["mae"] == pytest.approx(0.4) and r["rmse"] == pytest.approx(np.sqrt(0.6))


def test_fits_are_spread_over_tasks(spark, labelled, monkeypatch):
    """Also where the stored rows are one file; few rows stay as they are."""
    one = labelled.coalesce(1)
    assert supervised.spread(one).rdd.getNumPartitions() == 1
    monkeypatch.setattr(supervised, "FIT_ROWS", 30)
    spread, n = supervised.spread(one), one.count()
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == -(-n // 30) and max(sizes) <= 2 * 30
    assert spread.exceptAll(one).count() == 0 and spread.count() == n
    given = []
    monkeypatch.setattr(supervised, "spread", lambda rows: (given.append(rows.count()), rows)[1])
    supervised.feature_importance(labelled, "row", "size", ["x", "noise"], {}, trees=2)
    supervised.compare_models(labelled, "row", "size", ["x", "noise"], trees=2, boosts=2)
    assert given == [n, round(n * 0.8)]


def test_price_drivers_profile_one_table(spark, monkeypatch):
    from tallyloom.workload import analysis, profiling

    profiled, honest = [], profiling.profile.profile_tables
    monkeypatch.setattr(profiling, "_stored", {})
    monkeypatch.setattr(profiling.profile, "profile_tables", lambda tables: (profiled.extend(tables), honest(tables))[1])
    monkeypatch.setattr(analysis.supervised, "feature_importance", lambda df, key, target, features, distinct: distinct)
    distinct = analysis.price_drivers(spark, "/root/testdata/sf0.001")
    assert profiled == ["part"] and {"p_name", "p_brand", "p_type", "p_size"} <= set(distinct)


def test_importance_and_drivers(labelled):
    found = supervised.feature_importance(
        labelled, "row", "size", ["x", "noise", "colour"], {"x": 180, "noise": 200, "colour": 2}, trees=10
    )
    got = {r["name"]: r for r in rows(found.features)}
    assert got["x"]["rank"] == 1 and got["x"]["impact_level"] == "critical" and got["x"]["direction"] == "positive"
    assert sum(r["importance"] for r in got.values()) == pytest.approx(1.0)
    assert got["x"]["summary_insight"].startswith("Increases in 'X' strongly correlate with higher Size (+")
    along = rows(supervised.driver_relationships(labelled, found), "feature", "bin")
    assert {r["feature"] for r in along} == {"x", "noise"}
    averages_of_x = [r["target_avg"] for r in along if r["feature"] == "x"]
    assert len(averages_of_x) == 6 and averages_of_x == sorted(averages_of_x)
    assert {r["feature"] for r in rows(supervised.driver_relationships(labelled, found, top_k=1))} == {"x"}
    report = rows(supervised.driver_report(found.features), "place")
    assert report[0]["title"] == "Focus Strategy on Primary Lever: X"
    assert report[-1]["action"].startswith("Group records along dimensions 'x' and '")
