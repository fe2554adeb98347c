from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from llm_fixtures import awkward, components_of, documents  # noqa: F401

import tallyloom.llm.simhash as simhash
from tallyloom.llm import golay
from tallyloom.llm.components import connected_components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def close(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2


def test_fingerprints(awkward):
    got = simhash.fingerprints(awkward).collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect() if r.text is None or len(r.text) < 1000]
    want = sorted([(i, signed(plain_fingerprint(t))) for i, t in texts], key=str)
    short = {i for i, _ in texts}
    assert sorted([(r.id, r.fp) for r in got if r.id in short], key=str) == want
    long = next(r.fp for r in got if r.id == 6)
    assert long == signed(plain_fingerprint(next(r.text for r in awkward.collect() if r.doc_id == 6)))


def test_spark_hash_is_the_same(spark):
    text = "étage zéro un"
    assert spark.sql(f"SELECT xxhash64('{text}')").first()[0] == signed(xxhash.xxh64_intdigest(text.encode(), 42))


def test_golay_decodes_three_errors_and_shares_keys():
    draw = np.random.default_rng(3)
    words = draw.integers(0, 1 << 23, 500)
    for flips in range(3):
        other = words.copy()
        for i in range(len(other)):
            for b in draw.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        for a, b in zip(golay.shared_keys(words), golay.shared_keys(other)):
            assert set(a[a >= 0]) & set(b[b >= 0])
    indices = golay.codeword_index(words)
    assert len(golay.errors()) == 2048 and all(0 <= i < 4096 for i in indices)
    # Every word lies within three bits of its codeword: the remainder of the corrected word is zero.
    assert not golay.syndrome(words ^ golay.errors()[golay.syndrome(words)]).any()


def prints_near(seed, n, groups):
    draw = random.Random(seed)
    bases = [draw.getrandbits(64) for _ in range(groups)]
    found = set()
    while len(found) < n:
        x = draw.choice(bases)
        for b in draw.sample(range(64), draw.randint(0, 4)):
            x ^= 1 << b
        found.add(signed(x))
    return sorted(found)


def linked_components(spark, prints):
    links = simhash.links_between(spark.createDataFrame([(p,) for p in prints], "fp bigint").repartition(3))
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(close(a, b) for a, b in pairs)
    return pairs


def test_links_keep_all_components(spark, monkeypatch):
    """Small and large buckets, against all pairs."""
    for bucket, seed, n, groups in [(16, 1, 400, 4), (1, 2, 150, 3), (1000, 3, 150, 30)]:
        monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
        prints = prints_near(seed, n, groups)
        all_pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if close(a, b)]
        assert components_of(prints, linked_components(spark, prints)) == components_of(prints, all_pairs)


def test_large_buckets_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", 16)
    prints = prints_near(5, 1500, 1)
    assert len(linked_components(spark, prints)) < 100 * len(prints)


def test_components_of_documents(documents):
    base = " ".join(f"w{i}" for i in range(3000))
    pairs = [(5, base), (3, base + " end"), (9, base.upper()), (4, "other text that stands alone"), (8, None), (2, ""), (7, "  ")]
    pairs += [(3, base + " end")]
    got = {(r.id, r.component_id) for r in simhash.near_duplicates(documents(pairs)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in pairs}
    want = components_of(sorted(prints), [(a, b) for a in prints for b in prints if a != b and close(prints[a], prints[b])])
    assert got == set(want.items())
    assert want[9] == want[5] and want[8] == want[7] == 2


def test_awkward_and_empty(awkward):
    got = simhash.near_duplicates(awkward)
    assert got.count() == awkward.count()
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 1 in ids and 2 not in ids and 4 in ids and 7 not in ids


def test_connected_components(spark):
    draw = random.Random(1)
    nodes = list(range(300))
    links = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (None, 3)]
    links += links[:10]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    clean = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == components_of({x for link in clean for x in link}, clean)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
