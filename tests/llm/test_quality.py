from __future__ import annotations

import numpy as np
import pytest
from llm_fixtures import awkward, documents, sentence, with_clashes  # noqa: F401

from tallyloom.llm import quality
from tallyloom.llm.queries import Q


def good(i):
    return ". ".join(sentence(i * 10 + k, 12).capitalize() for k in range(5)) + "."


def bad(i):
    return " | ".join(sentence(i, 30).upper().split()) + " ###"


@pytest.fixture(scope="module")
def taught(documents, spark):  # noqa: F811
    docs = documents([(i, good(i) if i % 2 else bad(i)) for i in range(200)])
    labels = with_clashes(spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int"))
    return docs, quality.co_train(docs, labels)


def test_unlabelled_documents_are_told_apart(taught):
    docs, model = taught
    got = {r.id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].keep == bool(i % 2) for i in range(60, 200))
    assert all(0 <= r.score <= 1 and 0 <= r.metadata_score <= 1 for r in got.values())


def test_views_teach_each_other(documents, spark):  # noqa: F811
    """The source tells good from bad in the unlabelled documents; the labels leave that to the text."""
    docs = documents([(i, good(i)) for i in range(1, 300, 2)], source="clean").unionByName(
        documents([(i, bad(i)) for i in range(0, 300, 2)], source="dirty")
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    model = quality.co_train(docs, labels)
    texts = np.array([quality.text_features(good(1))] * 2)
    metadata = np.array([quality.metadata_features(good(1), s, "en") for s in ("clean", "dirty")])
    _, by_source, _ = model.probabilities(texts, metadata)
    assert by_source[0] > 0.5 > by_source[1]


def test_awkward(taught, awkward):  # noqa: F811
    _, model = taught
    got = quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(awkward.limit(0), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(4, 1)], [(4, 1), (4, 0), (None, 1), (2, None), (5, 7)]])
def test_few_or_no_labels(spark, awkward, rows):  # noqa: F811
    model = quality.co_train(awkward, spark.createDataFrame(rows, "doc_id bigint, quality int"))
    got = quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q["op3_quality"](spark, sf).where("held_out").join(labels, "doc_id")
    right = got.where("keep = (quality = 1)").count()
    assert right >= 0.93 * got.count() > 0


def features_of(pairs):
    rows = [(t, "s", "en") for _, t in pairs]
    return [np.array([quality.text_features(t) for t, _, _ in rows]), np.array([quality.metadata_features(*r) for r in rows])]


def test_rounds_equal_a_plain_version(documents, spark):  # noqa: F811
    """All unlabelled documents, sorted and cut in one piece, give the same weights."""
    draw = np.random.default_rng(8)
    pairs = [(i, " ".join(draw.choice([good(i), bad(i), sentence(i, 9)], 2))) for i in range(400)]
    known = {i: int("|" not in t) for i, t in pairs[:80]}
    model = quality.co_train(documents(pairs), spark.createDataFrame(list(known.items()), "doc_id bigint, quality int"))

    u = {r.id: r.u for r in spark.range(400).selectExpr("id", f"pmod(xxhash64(id, 'order'), {1 << 30}) / {1 << 30} AS u").collect()}
    x, y = features_of(pairs[:80]), np.array([known[i] for i, _ in pairs[:80]], float)
    order = np.lexsort([*x[0][np.argsort(y, kind="stable")].T])
    order = np.argsort(y, kind="stable")[order]
    x, y = [v[order] for v in x], y[order]
    held = np.arange(80) % quality.CALIBRATION == 0
    own, own_y = [v[~held] for v in x], y[~held]
    pool, jitter = features_of(pairs[80:]), np.array([u[i] for i, _ in pairs[80:]])

    def fit(rows, labels, scale):
        v = quality.Logistic.blank(*scale)
        for _ in range(60):
            v, _ = v.stepped(v.slopes(rows, labels), quality.RIDGE)
        return v

    scales = [(np.concatenate([a, b]).mean(axis=0), np.concatenate([a, b]).std(axis=0)) for a, b in zip(own, pool)]
    scales = [(m, np.where(s < 1e-7, 0, s)) for m, s in scales]
    taught, free = [[], []], np.ones(len(jitter), bool)
    views = [fit(a, own_y, s) for a, s in zip(own, scales)]
    for _ in range(quality.ROUNDS):
        for one in (0, 1):
            logits = views[one].logits(pool[one])
            certain = np.floor((np.minimum(np.abs(logits), 50) + quality.SPREAD * jitter) / quality.BIN)
            for label, share in ((0, 1 - y.mean()), (1, y.mean())):
                mine = np.flatnonzero(free & ((logits >= 0) == label) & (np.abs(logits) >= quality.LEAST_LOGIT))
                n = int(np.ceil(quality.HANDED_OVER * len(jitter) * share))
                least = np.sort(certain[mine])[-n] if len(mine) >= n else 0
                took = mine[certain[mine] >= least]
                taught[1 - one] += [(k, label) for k in took]
            free[[k for side in taught for k, _ in side]] = False
        views = [
            fit(np.concatenate([a, p[[k for k, _ in t]]]), np.concatenate([own_y, [c for _, c in t]]), s)
            for a, p, t, s in zip(own, pool, taught, scales)
        ]
    assert sum(map(len, taught)) > 50
    for got, want in zip(model.views, views):
        assert np.abs(got.weights - want.weights).max() < 0.02


def test_every_unlabelled_document_is_a_candidate(documents, spark, monkeypatch):  # noqa: F811
    """Whatever their number, all are counted when a round looks for the surest."""
    seen = []
    summed = quality._summed
    monkeypatch.setattr(quality, "_summed", lambda pool, work, length: (seen.append(pool.count()), summed(pool, work, length))[1])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    quality.co_train(documents([(i, good(i) if i % 2 else bad(i)) for i in range(120)]), labels)
    assert set(seen) == {100}
