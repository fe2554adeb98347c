from __future__ import annotations

import re

import pytest
from llm_fixtures import awkward, documents, sentence, with_clashes  # noqa: F401

import tallyloom.llm.decontaminate as decontaminate


def shingles(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(docs, items):
    out = set()
    of_docs, of_items = {}, {}
    for rows, of in ((docs, of_docs), (items, of_items)):
        for key, text in rows:
            if key is not None:
                of.setdefault(key, set()).update(shingles(text))
    for d, a in of_docs.items():
        for i, b in of_items.items():
            if b and len(a & b) * 100 >= 80 * len(b):
                out.add((d, i, len(a & b), len(b)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    def build(rows):
        return with_clashes(spark.createDataFrame(rows, "item_id bigint, text string"))

    return build


ITEMS = [(i, sentence(100 + i, n)) for i, n in enumerate([5, 6, 9, 20, 40, 63, 64, 200])]
ITEMS += [(20, None), (21, ""), (22, "short"), (23, "two words"), (24, ITEMS[3][1]), (None, "no id of this item here"), (3, ITEMS[3][1])]


def hidden(item, keep, lead=300):
    """A long document that holds the first ``keep`` words of an item, with other case and punctuation."""
    words = ITEMS[item][1].split()[:keep]
    return sentence(item, lead) + "\n" + ", ".join(words).upper() + "!\n" + sentence(50 + item, lead)


DOCS = [(k, hidden(k, len(t.split()))) for k, (i, t) in enumerate(ITEMS[:8])]
DOCS += [(100 + k, hidden(k, int(0.85 * len(t.split())))) for k, (i, t) in enumerate(ITEMS[:8])]
DOCS += [(200 + k, hidden(k, int(0.7 * len(t.split())))) for k, (i, t) in enumerate(ITEMS[:8])]
DOCS += [(300, "short"), (301, "Two, words."), (302, "two words more"), (303, sentence(9, 30_000) + " " + ITEMS[4][1])]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_against_all_pairs(documents, benchmark, monkeypatch, limit):  # noqa: F811
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    got = decontaminate.contaminated(documents(DOCS), benchmark(ITEMS)).collect()
    want = expected(DOCS, ITEMS)
    assert len(got) == len(want) and {(r.id, r.item, r.n_found, r.n_shingles) for r in got} == want
    assert {(d, d) for d in range(8)} <= {(r.id, r.item) for r in got} and (303, 4) in {(r.id, r.item) for r in got}


def test_awkward(awkward, benchmark):  # noqa: F811
    pairs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [*ITEMS, (30, "word"), (31, "1234 5678")]
    got = decontaminate.contaminated(awkward, benchmark(items)).collect()
    assert {(r.id, r.item, r.n_found, r.n_shingles) for r in got} == expected(pairs, items)
    kept = decontaminate.drop_contaminated(awkward, benchmark(items))
    assert kept.columns == awkward.columns
    gone = {r.id for r in got}
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i, _ in pairs if i not in gone], key=str)


def test_empty_sides(documents, benchmark):  # noqa: F811
    docs, items = documents(DOCS[:2]), benchmark(ITEMS[:2])
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 2


@pytest.mark.parametrize("node", ["Python", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"])
def test_plan_is_native(documents, benchmark, node):  # noqa: F811
    plan = decontaminate.contaminated(documents(DOCS[:2]), benchmark(ITEMS[:2]))._jdf.queryExecution().executedPlan().toString()
    assert node not in plan
