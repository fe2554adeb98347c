from __future__ import annotations

import random

import numpy as np
import pytest
from llm_fixtures import awkward, components_of, documents, sentence  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) * 100 >= 80 * len(a | b)


def edited(text, seed, n):
    draw, words = random.Random(seed), text.split()
    for at in draw.sample(range(len(words)), n):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


BASE = sentence(1, 200)
GROUP = [(i, edited(BASE, i, i % 5)) for i in range(10, 50)]
OTHERS = [(100 + i, edited(sentence(2, 120), i, 20)) for i in range(20)] + [(200, "one two"), (201, "One  TWO"), (202, "one two three")]


def test_the_stage_drops_near_copies_of_a_similarity_of_four_fifths(spark, documents):  # noqa: F811
    """Beyond two bits of the fingerprint."""
    copy = edited(BASE, 3, 3)
    assert alike(shingles(BASE), shingles(copy))
    assert (simhash.fingerprint(BASE) ^ simhash.fingerprint(copy)).bit_count() > 2
    docs = documents([(1, BASE), (2, copy), (3, edited(BASE, 4, 60))])
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near_copies(spark, docs, "").collect()) == [1, 3]


@pytest.mark.parametrize("bucket, leaders", [(1000, 8), (2, 1), (2, 4)])
def test_components_equal_all_pairs(documents, monkeypatch, bucket, leaders):  # noqa: F811
    monkeypatch.setattr(near_copies, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    pairs = GROUP + OTHERS + [(5, None), (6, " ")]
    sets = {i: shingles(t) for i, t in pairs}
    want = components_of(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    got = {r.id: r.component_id for r in near_copies.near_copies(documents(pairs)).collect()}
    assert got == want and got[201] == 200 and got[6] == 5


def compared(documents, monkeypatch, pairs):  # noqa: F811
    """How many pairs are verified."""
    counts, similar = [], near_copies._similar

    def counting(listed, sets):
        counts.append(listed.count())
        return similar(listed, sets)

    with monkeypatch.context() as patch:
        patch.setattr(near_copies, "_similar", counting)
        found = {r.id: r.component_id for r in near_copies.near_copies(documents(pairs)).collect()}
    return sum(counts), found


@pytest.mark.parametrize("words, edits", [(60, 4), (200, 12)])
def test_a_group_without_near_members_stays_linear(documents, monkeypatch, words, edits):  # noqa: F811
    """Texts on one frame of which no two are near copies: twice as many take about twice the work.

    Small buckets are paired up, at most ``PAIR_BUCKET`` / 2 pairs a member; set low, so that few texts reach that bound.
    """
    monkeypatch.setattr(near_copies, "PAIR_BUCKET", 3)
    frame = sentence(7, words)
    one, two = (compared(documents, monkeypatch, [(i, edited(frame, i, edits)) for i in range(n)]) for n in (150, 300))
    assert two[1] == {i: i for i in range(300)}
    assert two[0] <= 2.5 * one[0] + 300 and two[0] < 300 * 30


def test_texts_on_a_frame_have_no_rare_pairs(spark):
    """Where each text has own shingles enough, the join by rare shingles lists nothing, however many there are."""
    texts = [edited(sentence(7, 200), i, 8) for i in range(400)]
    sets = [(i, near_copies.shingle_set(t).view(np.int64).tolist()) for i, t in enumerate(texts)]
    listed = spark.createDataFrame(sets, "node bigint, hashes array<bigint>")
    parts = spark.range(len(sets)).select(F.col("id").alias("node"), F.col("id").alias("part"))
    assert near_copies.rare_pairs(listed, parts).count() == 0


def test_a_large_group_of_copies_stays_linear(documents, monkeypatch):  # noqa: F811
    one, two = (compared(documents, monkeypatch, [(i, edited(BASE, i, 1)) for i in range(n)]) for n in (150, 300))
    assert set(two[1].values()) == {0}
    assert two[0] <= 2.5 * one[0] and two[0] < 300 * 50


def test_keys_find_pairs_at_the_threshold():
    """Of pairs of sets at a similarity of 0.8 nearly all share a key, and few at 0.4 do."""
    draw = np.random.default_rng(11)

    def met(common, own, times):
        least = []
        for _ in range(times):
            both = draw.integers(0, 1 << 63, common, dtype=np.uint64)
            least += [near_copies.minima(np.concatenate([both, draw.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2)]
        keys, prints = near_copies.golay_keys(np.stack(least))
        differ = [np.bitwise_count((prints[k] ^ prints[k + 1]).view(np.uint64)).sum() for k in range(0, 2 * times, 2)]
        share = [bool(set(keys[k].tolist()) & set(keys[k + 1].tolist())) for k in range(0, 2 * times, 2)]
        return np.mean(share), np.mean(np.array(differ) <= near_copies.MOST_BITS)

    hit, close = met(160, 20, 1500)
    assert hit >= 0.99 and close == 1
    assert met(80, 60, 300)[0] < 0.35


@pytest.mark.parametrize("frequent", [1_000_000, 5, 0])
def test_rare_pairs_miss_none(spark, monkeypatch, frequent):
    """All pairs of random sets that reach the similarity are listed, whatever the parts."""
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    draw = random.Random(5)
    bases = [[draw.randrange(1 << 40) for _ in range(60)] for _ in range(3)]
    made = [sorted(set(draw.sample(b, draw.randint(40, 60)) + [draw.randrange(1 << 40) for _ in range(draw.randint(0, 8))])) for b in bases for _ in range(40)]
    parts = [i % 4 for i in range(len(made))]
    sets = spark.createDataFrame(list(enumerate(made)), "node bigint, hashes array<bigint>")
    known = spark.createDataFrame(list(enumerate(parts)), "node bigint, part bigint")
    got = {(r.a, r.b) for r in near_copies.rare_pairs(sets, known).collect()}
    want = {
        (a, b)
        for a in range(len(made))
        for b in range(a)
        if parts[a] != parts[b] and alike(set(made[a]), set(made[b]))
    }
    assert want and want <= got and (not frequent or len(got) < len(made) ** 2 / 4)


def test_awkward_and_empty(awkward):  # noqa: F811
    got = near_copies.near_copies(awkward)
    assert got.count() == awkward.count()
    assert near_copies.near_copies(awkward.limit(0)).count() == 0
    kept = near_copies.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 1 in ids and 2 not in ids and 4 in ids and 7 not in ids
