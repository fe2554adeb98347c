"""Exact quantiles without shuffling the values: brackets that close in on a rank.

A sketch gives two values that should enclose the wanted rank, a scan counts how many rows lie below, at and between them, and
only the values of a small enough bracket are grouped. A bracket that still holds too many rows is sketched again from the
inside. Counts decide, so the result is exact even where the sketch is off, and ties at the edges of a bracket, however many,
settle the rank at once. Each round shrinks a bracket some thousandfold: what is shuffled is bounded by ``KEEP`` rows a rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exprs import known

#: Relative error of a sketch is 1 / ACCURACY; edges are asked for SLACK times that far on either side.
ACCURACY = 10_000
SLACK = 1.5
#: Rows of a bracket from which it is sketched again instead of being grouped.
KEEP = 100_000


@dataclass
class _Rank:
    """A wanted 0-based rank of a column: its value lies strictly between ``low`` and ``high`` (None: no edge), where
    ``inside`` rows are and before which ``before`` rows are."""

    column: int
    rank: int
    before: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self) -> Column:
        x = F.col(f"c{self.column}")
        found = x.isNotNull()
        if self.low is not None:
            found = found & (x > F.lit(self.low))
        return found if self.high is None else found & (x < F.lit(self.high))

    def shares(self) -> list[float]:
        """Where in the bracket the edges of the next one should be, on the grid of the sketch, so that neighbours mostly share them."""
        at = (self.rank - self.before) / max(self.inside - 1, 1) * ACCURACY
        return [max(0.0, (math.floor(at) - SLACK) / ACCURACY), min(1.0, (math.ceil(at) + SLACK) / ACCURACY)]

    def settle(self, low: float, high: float, under: int, at_low: int, between: int, at_high: int) -> None:
        """Take in the rows of the bracket below ``low``, at it, between the two, and at ``high``."""
        place = self.rank - self.before
        if place < under:
            self.high, self.inside = low, under
        elif place < under + at_low:
            self.value = low
        elif place < under + at_low + between:
            self.before, self.inside, self.low, self.high = self.before + under + at_low, between, low, high
        elif low < high and place < under + at_low + between + at_high:
            self.value = high
        else:
            skipped = under + at_low + between + (at_high if low < high else 0)
            self.before, self.inside, self.low = self.before + skipped, self.inside - skipped, high


def _alike(wanted: list[_Rank]) -> dict[tuple, list[_Rank]]:
    """Ranks by the bracket they share."""
    found: dict[tuple, list[_Rank]] = {}
    for r in wanted:
        found.setdefault((r.column, r.low, r.high), []).append(r)
    return found


def _sketched(x: DataFrame, wanted: list[_Rank]) -> list[tuple[float, float]]:
    """Edges for each rank; one sketch a bracket serves all of its ranks."""
    asked = {key: sorted({s for r in rs for s in r.shares()}) for key, rs in _alike(wanted).items()}
    sketches = [
        F.percentile_approx(F.when(rs[0].within(), F.col(f"c{rs[0].column}")), asked[key], ACCURACY).alias(f"e{i}")
        for i, (key, rs) in enumerate(_alike(wanted).items())
    ]
    told = {key: dict(zip(asked[key], edges, strict=True)) for key, edges in zip(asked, x.agg(*sketches).head(), strict=True)}
    return [tuple(told[r.column, r.low, r.high][s] for s in r.shares()) for r in wanted]


def _counted(x: DataFrame, wanted: list[_Rank], edges: list[tuple[float, float]]) -> None:
    """Count each column's rows at and between all of its edges, and settle the ranks. The place of a value is twice the
    number of edges below it, and one more at an edge."""
    cuts = {c: sorted({e for r, pair in zip(wanted, edges, strict=True) if r.column == c for e in pair}) for c in {r.column for r in wanted}}
    listed = [(c, np.array(cuts[c])) for c in cuts]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [np.zeros(2 * len(e) + 1, "int64") for _, e in listed]
        for batch in batches:
            for k, (_, e) in enumerate(listed):
                v = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                tally[k] += np.bincount(np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right"), minlength=len(tally[k]))
        for (c, _), n in zip(listed, tally, strict=True):
            yield pa.record_batch([pa.array(np.full(len(n), c), pa.int32()), pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["column", "place", "rows"])

    counted = x.select(*[f"c{c}" for c in cuts]).mapInArrow(places, "column int, place int, rows bigint")
    rows = {(r["column"], r["place"]): r["n"] for r in counted.groupBy("column", "place").agg(F.sum("rows").alias("n")).collect()}

    def at(c: int, e: float) -> int:
        return rows.get((c, 2 * cuts[c].index(e) + 1), 0)

    def below(c: int, e: float) -> int:
        return sum(rows.get((c, k), 0) for k in range(2 * cuts[c].index(e) + 1))

    for r, (low, high) in zip(wanted, edges, strict=True):
        under, at_low = below(r.column, low), at(r.column, low)
        between = below(r.column, high) - under - at_low if low < high else 0
        r.settle(low, high, under - r.before, at_low, between, at(r.column, high))


def _gathered(x: DataFrame, wanted: list[_Rank]) -> None:
    """Group the values of all brackets, and read off the ranks."""
    held = list(_alike(wanted).values())
    places = {c: k for k, c in enumerate(dict.fromkeys(rs[0].column for rs in held))}
    bounds = [(places[rs[0].column], -math.inf if rs[0].low is None else rs[0].low, math.inf if rs[0].high is None else rs[0].high, rs[0].low is None, rs[0].high is None) for rs in held]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).drop_null().to_numpy(zero_copy_only=False) for k in range(len(places))]
            for i, (k, low, high, from_low, to_high) in enumerate(bounds):
                v = columns[k]
                found = v[((v > low) | from_low) & ((v < high) | to_high)]
                if len(found):
                    yield pa.record_batch([pa.array(np.full(len(found), i), pa.int32()), pa.array(found)], ["bracket", "value"])

    long = x.select(*[f"c{c}" for c in places]).mapInArrow(cells, "bracket int, value double")
    counts = long.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(W.partitionBy("bracket").orderBy("value"))
    ends = counts.select("bracket", "value", "rows", upto.alias("upto"))
    ranks = F.array(*[F.array(*[F.lit(r.rank - r.before) for r in rs]).cast("array<bigint>") for rs in held])
    hits = ends.select("*", F.posexplode(F.get(ranks, F.col("bracket"))).alias("k", "place"))
    for hit in hits.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("rows"))).collect():
        held[hit["bracket"]][hit["k"]].value = hit["value"]


def quantiles_of(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of numeric columns by linear interpolation: (column_name, probability, quantile, n).

    Nulls and NaN are left out; a column without values has no row. Only counts and a few values reach the driver.
    """
    spark, columns = df.sparkSession, list(columns)
    schema = "column_name string, probability double, quantile double, n bigint"
    if not columns:
        return spark.createDataFrame([], schema)
    x = df.select(*[known(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    first = x.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).head()
    ranks: dict[tuple[int, int], _Rank] = {}
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for p in probabilities if n else ():
            at = (n - 1) * p
            for k in (math.floor(at), math.ceil(at)):
                ranks.setdefault((i, k), _Rank(i, k, 0, n))
    while wide := [r for r in ranks.values() if r.value is None and r.inside > KEEP]:
        _counted(x, wide, _sketched(x, wide))
    if narrow := [r for r in ranks.values() if r.value is None]:
        _gathered(x, narrow)
    rows = []
    for i, name in enumerate(columns):
        n = first[f"n{i}"]
        for p in probabilities if n else ():
            at = (n - 1) * p
            low, high = (ranks[i, k].value for k in (math.floor(at), math.ceil(at)))
            quantile = low if low == high else low + (high - low) * (at - math.floor(at))
            rows.append((name, float(p), float(quantile), n))
    return spark.createDataFrame(rows, schema)
