"""Merkle manifests against plain recursion."""

from __future__ import annotations

import hashlib

import pytest
from llm_fixtures import awkward, documents, with_clashes  # noqa: F401
from pyspark.sql import functions as F

from tallyloom.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [None if v is None else str(v) for v in row]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(digests, arity):
    """The root, and for every digest its list of (left, right)."""
    paths, level, members = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, groups = [], []
        for at in range(0, len(level), arity):
            run = level[at : at + arity]
            for k, below in enumerate(members[at : at + arity]):
                for i in below:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            groups.append([i for below in members[at : at + arity] for i in below])
        level, members = up, groups
    return level[0], paths


def expected(rows, arity=3):
    """{(leaf, position, group): (subroot, root, path)}."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        leaves = [leaf(r) for r in ordered]
        done.append((name, leaves, *tree(leaves, arity)))
    root, tops = tree([d[2] for d in done], arity)
    return {
        (name, i): (leaves[i], sub, root, paths[i] + tops[t])
        for t, (name, leaves, sub, paths) in enumerate(done)
        for i in range(len(leaves))
    }


def found(df, arity=3):
    made = merkle.manifest(df, "doc_id", "source", COLUMNS, arity)
    made = made.withColumns({"folded": merkle.fold(F.col("leaf"), F.col("path")), "proof": merkle.proof(F.col("path"))}).collect()
    assert all(r.folded == r.root for r in made)
    assert all(r.proof == h(*[s.left + s.right for s in r.path]) for r in made)
    return {(r.grp, r.position): (r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in made}


ROWS = (
    [(i, "hot", "en", i % 7, f"text {i}\n") for i in range(1, 101)]
    + [(i, s, None, None, None if i % 2 else "é") for s, n in (("b", 1), ("é", 2), ("Z", 3), ("", 4), ("c", 10), (None, 5)) for i in range(n)]
    + [(7, "c", "en", 1, "same id"), (7, "c", "en", 1, "same id"), (None, "c", "en", 1, "no id"), (None, None, None, None, None)]
)
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_plain_recursion(spark, arity):
    df = with_clashes(spark.createDataFrame(ROWS, SCHEMA)).repartition(5)
    assert found(df, arity) == expected(ROWS, arity)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:2], ROWS[:3], ROWS[:4]])
def test_small_trees(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == (expected(rows) if rows else {})


def test_awkward(awkward):  # noqa: F811
    rows = [tuple(r[c] for c in COLUMNS) for r in awkward.collect()]
    assert found(awkward) == expected(rows)


def test_tampering_shows(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op11(spark, str(tmp_path)).collect()
    crc = {i: __import__("zlib").crc32(str(i).encode()) for i in range(101)}
    texts = {(r[0], leaf(r)): r[4] for r in ROWS}
    for r in made:
        changed = r.doc_id is not None and crc[r.doc_id] % 2 == 0 and "\n" in (texts[r.doc_id, r.leaf] or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)
    assert {r.verified for r in made} == {True, False}
