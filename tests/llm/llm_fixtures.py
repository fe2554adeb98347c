"""Fixtures and plain helpers that the tests of this folder import; not a conftest, as the folder above has one."""

from __future__ import annotations

import random

import pytest

#: Names that the operators use inside, as extra columns of their inputs.
CLASHES = "id fp key hash leaf version line line_no tokens words short_hash rule host score ids label n_turns span _id _text __line_id".split()


def with_clashes(df):
    """The frame with a null column under every name that an operator might use inside."""
    taken = set(df.columns)
    return df.selectExpr("*", *[f"CAST(NULL AS STRING) AS `{name}`" for name in CLASHES if name not in taken])


def sentence(seed: int, n: int = 60) -> str:
    """``n`` invented words, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a frame of documents with all columns of the table, and clashing ones, from (doc_id, text)."""

    def build(pairs, lang="en", source="s"):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in pairs]
        return with_clashes(
            spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        ).repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls everywhere, empty, very long and repeated texts, a repeated row, a null id."""
    return documents(
        [
            (1, None),
            (2, ""),
            (3, " \t\n"),
            (4, "word"),
            (5, "x" * 300_000),
            (6, "é" + "ab " * 60_000),
            (7, "word"),
            (7, "word"),
            (None, "word"),
            (None, None),
            (8, "1234 5678 !!!"),
            (9, "\x00 control \x1c and \x85 space"),
        ]
    )


def components_of(nodes, links):
    """The smallest node of each node's component, by union-find."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
