"""TF-IDF and lexical richness against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import pytest

from tallyloom.operators import text

DOCS = [
    (1, "The cat sat on the mat. The cat!"),
    (2, "A dog, a cat; two dogs"),
    (3, "ünïcode Ünïcode words-with-dashes 12 12 12"),
    (4, None),
    (5, ""),
    (6, "!!! ???"),
    (7, "the " * 50 + "end"),
]


def counted(docs):
    return {i: Counter(w for w in re.split(r"[\W_]+", (t or "").lower()) if w) for i, t in docs}


@pytest.fixture(scope="module")
def counts(spark):
    return text.term_counts(spark.createDataFrame(DOCS, "k bigint, t string").repartition(3), "k", "t")


@pytest.mark.parametrize("hot", [10_000, 3])
def test_scores_equal_plain_python(counts, monkeypatch, hot):
    """With all terms looked up in the broadcast table, and with few."""
    monkeypatch.setattr(text, "HOT_TERMS", hot)
    plain = {i: c for i, c in counted(DOCS).items() if c}
    df = Counter(w for c in plain.values() for w in c)
    idf = {w: math.log((1 + len(plain)) / (1 + n)) + 1 for w, n in df.items()}
    expected = {}
    for i, c in plain.items():
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        expected |= {(i, w): n * idf[w] / length for w, n in c.items()}
    got = {(r.doc, r.term): r.score for r in text.tfidf(counts).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)
    vocabulary = {r.term: (r.df, r.total) for r in text.vocabulary(counts).collect()}
    assert vocabulary == {w: (n, sum(c[w] for c in plain.values())) for w, n in df.items()}


def test_top_terms_break_ties_by_name(spark):
    scored = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9), (2, "z", 0.1)], "doc int, term string, score double")
    assert [(r.doc, r.place, r.term) for r in text.top_terms(scored, "doc", 2).orderBy("doc", "place").collect()] == [
        (1, 1, "c"),
        (1, 2, "a"),
        (2, 1, "z"),
    ]


def test_group_scores_count_documents_without_the_term(spark):
    scored = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.5)], "doc int, term string, score double")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "doc int, lang string")
    got = {r.term: r.score for r in text.group_scores(scored, groups, "lang").collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(0.5 / 3)}


@pytest.mark.parametrize("drawn", [2, 3, 42])
def test_diversity_equals_all_draws(counts, monkeypatch, drawn):
    """The expected share of different words over every possible draw."""
    monkeypatch.setattr(text, "DRAWN", drawn)
    got = {r.doc: r for r in text.lexical_richness(counts).collect()}
    for i, c in counted(DOCS).items():
        bag = list(c.elements())
        if not bag:
            assert i not in got
            continue
        assert got[i].n_words == len(bag) and got[i].n_terms == len(c)
        assert got[i].type_token == pytest.approx(len(c) / len(bag))
        assert got[i].once_share == pytest.approx(sum(n == 1 for n in c.values()) / len(c))
        size = min(drawn, len(bag))
        if math.comb(len(bag), size) < 50_000:
            draws = [len(set(d)) / size for d in combinations(bag, size)]
            assert got[i].diversity == pytest.approx(sum(draws) / len(draws))


def test_empty(spark):
    counts = text.term_counts(spark.createDataFrame([], "k bigint, t string"), "k", "t")
    assert text.tfidf(counts).collect() == [] and text.lexical_richness(counts).collect() == []


def test_texts_are_spread_before_they_are_cut(spark, monkeypatch):
    """One scan task must not cut all texts into words."""
    plans = []
    monkeypatch.setattr(text, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    found = text.term_counts(spark.createDataFrame(DOCS, "k bigint, t string").coalesce(1), "k", "t")
    assert "Rebalance" in plans[0].split("Generate", 1)[1]
    assert {(r.doc, r.term): r.n for r in found.collect()} == {(i, w): n for i, c in counted(DOCS).items() for w, n in c.items()}
