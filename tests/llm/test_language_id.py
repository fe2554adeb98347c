from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from llm_fixtures import awkward, documents  # noqa: F401
from pyspark.sql import functions as F

from tallyloom.llm import language_id
from tallyloom.llm.queries import Q

EN = "the quick brown fox jumps over the lazy dog and then walks with the others through this wide field of grass "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann mit den anderen durch diese weite wiese "
RU = "быстрая лисица прыгает через ленивую собаку и потом идёт вместе с другими через широкое поле травы "


@pytest.fixture(scope="module")
def model(documents):  # noqa: F811
    rows = documents([(i, EN * 3) for i in range(20)], "en").unionByName(documents([(i, DE * 3) for i in range(20, 40)], "de"))
    return language_id.train(rows.unionByName(documents([(i, RU * 3) for i in range(40, 50)], "ru")))


def test_spans_of_mixed_text(model):
    text = EN + DE + EN * 2
    lang, score, spans = model.label(text)
    assert lang == "en" and 0.5 < score < 0.9
    assert [s[0] for s in spans] == ["en", "de", "en"]
    assert spans[0][1] == 0 and spans[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(spans, spans[1:]))
    assert abs(spans[1][1] - len(EN)) < 20 and abs(spans[1][2] - len(EN + DE)) < 20


def test_scripts_narrow(model):
    assert model.label("собака лисица")[0] == "ru"
    cyrillic = 1 + list(language_id.SCRIPTS).index("cyrillic")
    assert [k for k, ok in zip(model.languages, model.allowed[cyrillic]) if ok] == ["ru"]
    assert model.label("Zebra")[0] in {"en", "de"}
    # Letters that no language uses: the most frequent language at its share.
    lang, score, _ = model.label("漢字")
    assert lang in model.languages and score < 0.3


def test_words_and_grams():
    text = "Ab, \u0301c\u0301d  ÉX1y \u4e2d"
    words = language_id.words_of(np.array([ord(c) for c in text]))
    assert [text[a:b] for a, b in zip(words.starts, words.ends)] == ["Ab", "c\u0301d", "ÉX", "y", "\u4e2d"]
    # A word of n letters has n + (n + 1) + n + (n - 1) n-grams of one to four characters, a space on either side included.
    assert np.bincount(words.owners).tolist() == [8, 12, 8, 4, 4]
    alone = language_id.words_of(np.array([ord(c) for c in "éx"]))
    assert sorted(words.slots[words.owners == 2]) == sorted(alone.slots)


def test_pieces_make_no_difference(model, monkeypatch):
    text = (EN + DE) * 3
    whole = model.emissions(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.emissions(text)))


def test_best_path_is_the_best():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n, width = draw.integers(1, 7), draw.integers(1, 4)
        emitted = draw.normal(size=(n, width)) * 3
        def value(p):
            return emitted[np.arange(n), p].sum() - 2.0 * np.count_nonzero(np.diff(p))

        best = max(value(np.array(p)) for p in itertools.product(range(width), repeat=n))
        assert value(language_id.best_path(emitted, 2.0)) == pytest.approx(best)


def test_awkward(spark, model, awkward):  # noqa: F811
    got = language_id.label_languages(awkward, model).collect()
    assert len(got) == awkward.count()
    by_id = {r.id: r for r in got}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == by_id[8].lang_pred == "und"
    assert by_id[1].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    assert by_id[5].lang_pred in model.languages
    kept = language_id.keep_identified(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == len([r for r in got if r.lang_pred != "und"])
    assert language_id.label_languages(awkward.limit(0), model).count() == 0


def test_no_labels(awkward):  # noqa: F811
    empty = language_id.train(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.label_languages(awkward, empty).collect()} == {"und"}


def test_fold(spark):
    got = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    got = Q["op6_language_id"](spark, sf).where("held_out").join(truth, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
