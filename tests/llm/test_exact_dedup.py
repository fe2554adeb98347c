from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from llm_fixtures import awkward, documents  # noqa: F401

from tallyloom.llm.exact_dedup import exact_duplicates


def expected(pairs):
    groups = defaultdict(list)
    for doc_id, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(df).collect()], key=str)


def test_awkward_rows(awkward):
    pairs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == expected(pairs)


def test_white_space_and_case(documents):
    pairs = [(1, "a b"), (2, "a \t\n b"), (3, "A b"), (4, " a b"), (5, "a\u00a0b"), (6, "  a b"), (7, "a\x0bb"), (8, "a\x85b")]
    assert found(documents(pairs)) == expected(pairs)


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_a_group_that_spans_ranges(spark, documents, partitions):
    """Half of the rows share a text, so that their run goes through many ranges, some of which it fills."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pairs = [(i, "hot text" if i % 2 else f"text {i % 50}") for i in range(400)]
        assert found(documents(pairs)) == expected(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(documents):
    assert found(documents([(1, "x")]).limit(0)) == []
