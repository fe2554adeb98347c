"""A Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, and a proof for every row.

Nodes of one level are numbered within their tree. Each level is joined with itself on the computed numbers of the
siblings (the number XOR 1 in a binary tree, slot offsets within the run of consecutive nodes otherwise), then the nodes in
slot zero emit their parents. Levels shrink by the arity, so all joins together move little more than the leaves do. On the
way down every node takes over its parent's path, which makes the proof of a row the list of what lies to its left and right
on each level. A group with a third of all rows is cut by the order of its rows like any other: keys are (tree, number),
never the group alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.ranking import global_rank
from tallyloom.session import materialise

ARITY = 3
#: monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits.
PLACE_BITS = 33

STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else the bytes of its text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda d, step: digest(step.left, d, step.right))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.left, step.right)), ""), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``_tree`` (the place of ``_group`` among the groups), ``_idx`` (the row's place in it, both from 0) and ``_n``.

    Rows are sorted by group, id and leaf over range partitions; a row per partition and group gives the offsets.
    """
    order = ["_group", "_id", "_leaf"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id())
    spread = spread.withColumns(
        {
            "_part": F.shiftright("_spot", PLACE_BITS).cast("int"),
            "_place": F.col("_spot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
        }
    ).drop("_spot")
    stored = materialise(spread, "merkle-leaves")
    spans = stored.groupBy("_part", "_group").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(
        F.col("_part").alias("_p"),
        F.col("_group").alias("_g"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(W.partitionBy("_group")).alias("_n"),
    )
    groups = global_rank(stored.select("_group").distinct(), "_group", [])
    groups = groups.select(F.col("_group").alias("_name"), (F.col("rank") - 1).alias("_tree"))
    spans = materialise(spans.join(groups, F.col("_g").eqNullSafe(F.col("_name"))).drop("_name"), "merkle-spans")
    here = (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g"))
    placed = stored.join(spans, here).withColumn("_idx", F.col("_place") + F.col("_shift"))
    return placed.drop("_p", "_g", "_part", "_place", "_shift")


def sibling_indices(idx: Column, arity: int) -> list[Column]:
    """The numbers of a node's siblings in a full run."""
    if arity == 2:
        return [idx.bitwiseXOR(F.lit(1))]
    first, slot = idx - idx % arity, idx % arity
    return [first + (slot + k) % arity for k in range(1, arity)]


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the digests of the siblings on either side, in order.

    ``nodes`` has tree, idx, n (the nodes of this level of the tree) and digest.
    """
    joined = nodes.withColumns({f"at{k}": at for k, at in enumerate(sibling_indices(F.col("idx"), arity))})
    for k in range(arity - 1):
        other = nodes.select(F.col("tree").alias("t"), F.col("idx").alias(f"i{k}"), F.col("digest").alias(f"d{k}"))
        joined = joined.join(other, (F.col("tree") == F.col("t")) & (F.col(f"at{k}") == F.col(f"i{k}")), "left").drop("t")
    # A missing sibling has a null digest, which concat_ws leaves out.
    found = F.array_sort(F.array(*[F.struct(F.col(f"i{k}").alias("i"), F.col(f"d{k}").alias("d")) for k in range(arity - 1)]))

    def side(test) -> Column:
        return F.concat_ws("", F.transform(F.filter(found, test), lambda s: s.d))

    return joined.select(
        "tree",
        "idx",
        "n",
        "digest",
        side(lambda s: s.i < F.col("idx")).alias("left"),
        side(lambda s: s.i > F.col("idx")).alias("right"),
    )


def _climb(leaves: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels with more than one node, from the leaves up, and the roots: (tree, level, digest).

    One pass a level, over all trees at once.
    """
    most = leaves.agg(F.max("n").alias("n")).head().n or 0
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        if most <= 1:
            break
        level = materialise(_with_siblings(nodes.where("n > 1"), arity), f"merkle-{label}")
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest(F.col("left"), F.col("digest"), F.col("right")).alias("digest"),
        )
        most = -(-most // arity)
    return levels, reduce(DataFrame.unionByName, roots)


def _descend(levels: list[DataFrame], roots: DataFrame, arity: int, label: str) -> DataFrame:
    """(tree, idx, path) and the other columns of ``roots`` for all nodes of the lowest level.

    ``roots`` has tree, level, path (of the root itself) and what its nodes are to inherit.
    """
    more = [c for c in roots.columns if c not in ("tree", "level", "path")]
    known: DataFrame | None = None
    for at in range(len(levels), -1, -1):
        top = roots.where(F.col("level") == at).select("tree", F.lit(0).cast("bigint").alias("idx"), "path", *more)
        if at == len(levels):
            known = top
            continue
        above = known.select(F.col("tree").alias("t"), F.col("idx").alias("parent"), F.col("path").alias("up"), *more)
        below = levels[at].join(above, (F.col("tree") == F.col("t")) & (F.expr(f"idx div {arity}") == F.col("parent")))
        step = F.array(F.struct("left", "right"))
        known = below.select("tree", "idx", F.concat(step, F.col("up")).alias("path"), *more).unionByName(top)
        if at:
            known = materialise(known, f"merkle-{label}")
    return known


def manifest(
    df: DataFrame,
    id_col: str,
    group_col: str,
    value_cols: Sequence[str],
    arity: int = ARITY,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row for each row of ``df``: ``id``, ``grp``, ``leaf``, ``position``, ``subroot``, ``root``, ``path``, and ``carry``.

    * A leaf is the digest of the values in the order given; a null differs from every text, also from an empty one.
    * Leaves of a group ascend by id, nulls first, rows with the same id by leaf. Groups ascend by their UTF-8 bytes, null first.
    * While more than one node is left, each run of ``arity`` consecutive ones (the last may be shorter, even one) becomes the
      digest of their digests. A lone leaf is the subroot itself, a lone subroot the root.
    * ``path`` has a step a level, from the leaf up: the digests to the left and to the right in the run. ``fold`` turns a leaf
      and a path into a root; ``proof`` gives the digest of the siblings.
    * ``carry`` are expressions over ``df`` that come along, by new names. Other columns are ignored, whatever their names.
      An empty table gives an empty one.
    """
    carry = dict(carry or {})
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(group_col).cast("string").alias("_group"),
        leaf_of([F.col(c) for c in value_cols]).alias("_leaf"),
        *[made.alias(name) for name, made in carry.items()],
    )
    placed = materialise(_placed(rows), "merkle-placed")
    leaves = placed.select(F.col("_tree").alias("tree"), F.col("_idx").alias("idx"), F.col("_n").alias("n"), F.col("_leaf").alias("digest"))
    levels, subroots = _climb(leaves, arity, "level")
    subroots = materialise(subroots, "merkle-subroots")

    n_trees = subroots.count()
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("bigint").alias("n"), "digest")
    top_levels, roots = _climb(tops, arity, "top")
    root = roots.select("tree", "level", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    paths = _descend(top_levels, root, arity, "top-path")
    paths = paths.select(F.col("idx").alias("tree"), "path", "root")
    subroots = materialise(subroots.withColumnRenamed("digest", "subroot").join(paths, "tree"), "merkle-subpaths")

    paths = _descend(levels, subroots, arity, "path").withColumnsRenamed({"tree": "_tree", "idx": "_idx"})
    return placed.join(paths, ["_tree", "_idx"]).select(
        F.col("_id").alias("id"), F.col("_group").alias("grp"), F.col("_leaf").alias("leaf"),
        F.col("_idx").alias("position"), "subroot", "root", "path", *carry,
    )
