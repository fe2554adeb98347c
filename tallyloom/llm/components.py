"""Connected components of an undirected graph given by its links, as rounds of star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Rounds after which the search gives up with an error; the number of rounds grows with the logarithm of a chain's length.
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them. Every link has ``b < a``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``component`` (the smallest node of its component) for every node that occurs in a link (``a``, ``b``).

    Links may repeat and point either way; links of a node to itself are ignored; nulls are ignored. Each round is written
    to the shared folder, so that its plan stays short and a lost executor costs one round. A star's centre with very many
    links is joined with one row, which adaptive execution splits.
    """
    clean = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    current = materialise(clean, label)
    before = None
    for _ in range(MAX_ROUNDS):
        current = materialise(_small_star(_large_star(current)), label)
        # An order-free fingerprint of the links: equal when a round has changed nothing.
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
