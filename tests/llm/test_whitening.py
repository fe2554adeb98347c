"""Whitening against NumPy in one piece."""

from __future__ import annotations

import math

import numpy as np
import pytest
from llm_fixtures import with_clashes

from tallyloom.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) / 4).astype("float32")


def run(spark, tmp_path, rows):
    with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op12(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("n", "d"), [(2500, 7), (1200, 40), (3, 2)])
def test_equals_numpy(spark, tmp_path, n, d):
    v = vectors(n, d)
    rows = [(i, [float(e) for e in v[i]], 1) for i in range(n)]
    bad = [(-1, None, 1), (-2, [math.nan] * d, 1), (-3, [math.inf] + [0.0] * (d - 1), 1), (-4, [None] * d, 1), (-5, [], 1), (-6, [1.0] * (d + 1), 1)]
    made = run(spark, tmp_path, rows + bad)

    x = np.floor(v.astype("float64") * 64).astype("int64") + 1_000_000
    s = x.sum(axis=0)
    c = (x * n - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:32]
    deviation = ((x * n - s) ** 2).sum(axis=1)
    k = len(order)
    assert len(made) == n * k
    white = np.zeros((n, k))
    for r in made:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[order[r.component - 1]] / values.sum(), rel_tol=1e-9)
        white[r.vec_id, r.component - 1] = r.whitened
    plain = c @ basis[:, order] / np.sqrt(values[order])
    signs = np.sign((plain * white).sum(axis=0))
    assert np.abs(plain * signs - white).max() < 1e-6
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9


def test_repeated_ids_and_constant_dimensions(spark, tmp_path):
    v = vectors(300, 4)
    made = run(spark, tmp_path, [(None if i % 3 else 5, [*map(float, v[i]), 0.5], None) for i in range(300)])
    assert len(made) == 300 * 4 and {r.component for r in made} == {1, 2, 3, 4}
    assert abs(sum(r.explained for r in made) / 300 - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_blocks_of_columns(spark, monkeypatch):
    """Several blocks a row give the same matrices as one."""
    v = vectors(500, 23)
    df = spark.createDataFrame([(i, [float(e) for e in v[i]], 1) for i in range(500)], SCHEMA)
    grid = whitening.on_grid(df)
    whole = whitening.fit(grid, 9)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 32)
    parts = whitening.fit(grid, 9)
    assert np.allclose(whole.eigenvalues, parts.eigenvalues)
    assert whitening.identity_error(whitening.whiten(grid, parts), parts.n) < 1e-9
