"""The k-means sweep that advances all models at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array

from tallyloom.operators import clustering, lloyd


def points_of(spark, x, parts=5):
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>").repartition(parts)
    return df.select("k", array_to_vector("v").alias("vector"))


@pytest.fixture(scope="module")
def blobs():
    draw = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [12, 0, 0], [0, 12, 0], [0, 0, 12], [12, 12, 12]], float)
    return centres, np.concatenate([c + draw.normal(size=(n, 3)) for c, n in zip(centres, (300, 40, 40, 40, 5))])


def test_planted_blobs_are_found(spark, blobs):
    centres, x = blobs
    (found,) = clustering.sweep(points_of(spark, x), "k", [5], restarts=4)
    near = [np.linalg.norm(found["model"].points - c, axis=1).min() for c in centres]
    assert max(near) < 1.5 and sorted(found["model"].sizes) == [5, 40, 40, 40, 300]


def test_costs_are_not_above_separate_fits(spark, blobs):
    points = points_of(spark, blobs[1]).cache()
    for row in clustering.sweep(points, "k", [2, 3, 6], restarts=10):
        other = min(KMeans(featuresCol="vector", k=row["k"], seed=s, maxIter=100, tol=1e-4).fit(points).summary.trainingCost for s in range(5))
        assert row["inertia"] <= other * 1.001


def test_costs_sizes_and_silhouettes_are_those_of_the_assignment(spark, blobs):
    points = points_of(spark, blobs[1])
    for row in clustering.sweep(points, "k", [2, 4, 5], restarts=2):
        model = row["model"]
        labelled = points.withColumn("cluster", model.nearest(vector_to_array("vector")))
        assert row["silhouette"] == pytest.approx(clustering.silhouette(labelled), abs=1e-9)
        x, of = blobs[1], {r.k: r.cluster for r in labelled.collect()}
        labels = np.array([of[i] for i in range(len(x))])
        assert np.bincount(labels, minlength=row["k"]).tolist() == model.sizes.tolist()
        assert model.cost == pytest.approx(((x - model.points[labels]) ** 2).sum())


def test_partitions_do_not_matter(spark, blobs):
    one, two = (clustering.sweep(points_of(spark, blobs[1], n), "k", [3, 4], restarts=3) for n in (1, 7))
    for a, b in zip(one, two):
        assert a["inertia"] == pytest.approx(b["inertia"], rel=1e-9)


def test_passes_do_not_grow_with_models(spark, blobs, monkeypatch):
    calls = []
    plain = lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda rows, width, models: (calls.append(len(models)), plain(rows, width, models))[1])
    rows = lloyd.rows_of(points_of(spark, blobs[1]), "k")
    lloyd.fit_all(rows, 3, range(2, 9), 10, 1)
    assert max(calls) == 70 and len(calls) <= lloyd.MAX_ITERATIONS + 1


@pytest.mark.parametrize("x", [np.zeros((12, 2)), np.array([[0.0, 1.0]] * 6 + [[2.0, 3.0]] * 6)])
def test_fewer_different_rows_than_centres(spark, x):
    rows = clustering.sweep(points_of(spark, x), "k", [2, 3], restarts=2)
    assert [r["inertia"] for r in rows] == [0.0, 0.0]
    assert [r["silhouette"] for r in rows] == ([0.0, 0.0] if not x.any() else [1.0, 1.0])


def test_draws_follow_squared_distance(spark):
    """Of two rows next to the first centre and one far off, the far one is drawn second nearly always."""
    x = np.array([[0.0], [0.1], [100.0]])
    rows = lloyd.rows_of(points_of(spark, x, 2), "k")
    seconds = [s[1][0] for s in lloyd.starts(rows, 1, 2, 60, 5) if s[0][0] != 100.0]
    assert seconds and np.mean(np.array(seconds) == 100.0) > 0.95


def test_the_nearest_centres_of_many_models_and_of_equally_near_ones_the_first():
    rng = np.random.default_rng(3)
    models = [rng.normal(size=(k, 3)) for k in range(2, 9) for _ in range(10)]
    edges, x = np.cumsum([0, *[len(m) for m in models]]), rng.normal(size=(2048, 3))
    x[:5], models[0][:] = 0.0, [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]]
    stacked = np.concatenate(models)
    distance = ((stacked[:, None, :] - x[None]) ** 2).sum(axis=2)
    own = lloyd._nearest(distance, edges)
    for a, b in zip(edges[:-1], edges[1:]):
        assert (own[a:b].argmax(axis=0) == distance[a:b].argmin(axis=0)).all() and (own[a:b].sum(axis=0) == 1).all()


def test_costs_are_added_up_for_the_last_models_only(spark, blobs):
    rows = lloyd.rows_of(points_of(spark, blobs[1]), "k")
    models = [blobs[1][:k] for k in (2, 5)]
    plain, last = lloyd._pass(rows, 3, models), lloyd._totals(rows, 3, models, costs=True)
    for centres, (n, sums, none), (m, same, costs) in zip(models, plain, last, strict=True):
        gaps = ((blobs[1][:, None] - centres) ** 2).sum(axis=2)
        of = gaps.argmin(axis=1)
        assert (n == np.bincount(of, minlength=len(centres))).all() and (m == n).all() and not none.any()
        assert np.allclose(sums, [blobs[1][of == c].sum(axis=0) for c in range(len(centres))]) and np.allclose(sums, same)
        assert np.allclose(costs, [gaps[of == c, c].sum() for c in range(len(centres))])


def stored(x, h=None):
    """The blocks of rows, as a task reads them."""
    return list(lloyd._blocks(lloyd._packed(np.arange(len(x)) if h is None else h, x)))


@pytest.mark.parametrize("n", [1, 7, 16, 25, 1000, 70_001])
def test_cells_hold_every_row_once_and_their_boxes_hold_their_rows(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    x[: n // 3] = x[0]
    blocks = stored(x)
    assert sorted(np.concatenate([b.rows()[:3].T for b in blocks]).tolist()) == sorted(x.tolist())
    assert sorted(np.concatenate([b.h[b.x[-1].reshape(-1) > 0] for b in blocks])) == list(range(n))
    for b in blocks:
        for nodes in b.levels:
            held = b.x.reshape(4, len(nodes.scatter), -1)
            gaps = np.abs(held[:3] - nodes.middle[:3, :, None]) * (held[3] > 0)
            assert (gaps <= nodes.side[:, :, None] + 1e-12).all() and np.allclose(held.sum(axis=2), nodes.total)


def test_most_cells_are_taken_whole_and_rightly():
    rng = np.random.default_rng(5)
    x, model = rng.normal(size=(40_000, 3)), rng.normal(size=(5, 3))
    factors = np.column_stack([-2 * model, (model * model).sum(axis=1)])
    whole = 0
    for b in stored(x):
        cells = b.levels[1]
        own, sure = lloyd._decided(model, factors, cells, np.arange(len(cells.scatter)), 1e-12)
        for c in np.flatnonzero(sure):
            held = b.x[:3, c, b.x[3, c] > 0].T
            assert (((held[:, None] - model) ** 2).sum(axis=2).argmin(axis=1) == own[c]).all()
        whole += cells.total[-1][sure].sum()
    assert whole > 0.6 * len(x)


@pytest.mark.parametrize("width", [1, 3, 40])
def test_totals_are_those_of_all_rows_one_by_one(spark, width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(size=(4000, width)), np.round(rng.normal(size=(1500, width)))])
    models = [x[rng.integers(len(x), size=k)] + rng.normal(size=(k, width)) / 10 for k in (1, 2, 5, 8)]
    rows = lloyd.rows_of(points_of(spark, x, 3), "k")
    for centres, (n, sums, costs) in zip(models, lloyd._totals(rows, width, models, costs=True), strict=True):
        gaps = ((x[:, None] - centres) ** 2).sum(axis=2)
        of = gaps.argmin(axis=1)
        assert n.tolist() == np.bincount(of, minlength=len(centres)).tolist()
        assert np.allclose(sums, [x[of == c].sum(axis=0) for c in range(len(centres))])
        assert np.allclose(costs, [gaps[of == c, c].sum() for c in range(len(centres))])


def test_draws_are_those_of_a_race_of_all_rows(spark):
    x = np.random.default_rng(11).normal(size=(50_000, 2)) ** 3
    points = points_of(spark, x, 3)
    rows = lloyd.rows_of(points, "k")
    hashed = points.selectExpr("k", "xxhash64(k) AS h").toPandas().sort_values("k")["h"].to_numpy()
    for r, drawn in enumerate(lloyd.starts(rows, 2, 3, 2, 9)):
        for step in range(3):
            weight = np.min([((x - c) ** 2).sum(axis=1) for c in drawn[:step]], axis=0) if step else np.ones(len(x))
            with np.errstate(divide="ignore"):
                time = -np.log(lloyd._uniform(lloyd._bits(hashed, 9 + 1000 * r + step))) / weight
            assert drawn[step].tolist() == x[time.argmin()].tolist()


def test_measures_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.range(200).selectExpr("id", "id % 7 + id / 100 AS a", "id * id % 31 + 0.5 AS b")
    table = plain.selectExpr("id", "cast(a AS double) AS a", "cast(b AS double) AS b")
    found = clustering.cluster_table(table.mapInArrow(counted, table.schema), "id", max_k=3, restarts=2)
    assert found.assigned.count() == 200 and seen.value == 200


def test_few_blocks_are_read_at_once_and_settings_come_back(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ValueError), lloyd._few_at_once(spark):
        assert [spark.conf.get(n) for n in names] == [str(lloyd.SENT)] * 2
        raise ValueError
    assert [spark.conf.get(n) for n in names] == before
