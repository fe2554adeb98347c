"""Correlations of wide tables from blocked moments.

Each task turns its rows into matrix products, one Arrow batch after the other, and keeps a count, the means and the sums of
centred products. Two such summaries merge without loss of digits, so they are added up in a tree: the matrix is cut into
tiles of rows, tiles of some tasks are merged first, then all of a tile. The driver sees no matrix, and a table of 500 columns
takes one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the matrix in a tile, and tasks whose tiles are merged first.
TILE, FAN_IN = 64, 64

PARTIAL = "tile int, part int, n bigint, mean binary, spread binary, cross binary"


@dataclass
class Moments:
    """Rows seen, means of all columns, sums of squared deviations, and products of some columns with all.

    ``rows`` are the columns whose products are kept; every array is over all columns but ``cross`` (rows by columns).
    """

    width: int
    rows: slice
    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cross: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def add(self, n: int, mean: np.ndarray, spread: np.ndarray, cross: np.ndarray) -> None:
        if not n:
            return
        if not self.n:
            self.n, self.mean, self.spread, self.cross = n, mean, spread, cross
            return
        both, gap = self.n + n, mean - self.mean
        weight = self.n * (n / both)
        self.cross = self.cross + cross + np.outer(gap[self.rows], gap) * weight
        self.spread = self.spread + spread + gap * gap * weight
        self.mean = self.mean + gap * (n / both)
        self.n = both


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Column ``v`` as a matrix; null entries become NaN."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _as_rows(tile: int, part: int, m: Moments) -> dict:
    if not m.n:
        return {"tile": tile, "part": part, "n": 0, "mean": b"", "spread": b"", "cross": b""}
    packed = {"mean": m.mean, "spread": m.spread, "cross": m.cross}
    return {"tile": tile, "part": part, "n": m.n, **{k: np.ascontiguousarray(a).tobytes() for k, a in packed.items()}}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"tile": pa.int32(), "part": pa.int32(), "n": pa.int64(), "mean": pa.binary(), "spread": pa.binary(), "cross": pa.binary()}
    return pa.record_batch({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})


def _tiles(width: int) -> list[slice]:
    return [slice(at, min(at + TILE, width)) for at in range(0, width, TILE)]


def _summed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moments of the complete rows of a task, a row a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, base = Moments(width, slice(0, width)), None
        for batch in batches:
            x = _matrix(batch, width)
            x = x[~np.isnan(x).any(axis=1)]
            if not len(x):
                continue
            # Measured from the first row, a constant column is zero to the last bit.
            base = x[0].copy() if base is None else base
            x = x - base
            mean = x.mean(axis=0)
            x -= mean
            cross = x.T @ x
            whole.add(len(x), base + mean, np.diag(cross).copy(), cross)
        part = TaskContext.get().partitionId()
        for tile, rows in enumerate(_tiles(width)):
            own = Moments(width, rows, whole.n, whole.mean, whole.spread, whole.cross[rows] if whole.n else whole.cross)
            yield _batch([_as_rows(tile, part, own)])

    return run


def _merged(batches: Iterable[pa.RecordBatch], width: int, by_part: bool) -> dict[tuple[int, int], Moments]:
    """Summaries added up by tile, and by group of tasks if asked for."""
    tiles, found = _tiles(width), {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["tile"], row["part"] if by_part else 0)
            m = found.setdefault(key, Moments(width, tiles[row["tile"]]))
            if row["n"]:
                arrays = [np.frombuffer(row[k]) for k in ("mean", "spread", "cross")]
                m.add(row["n"], arrays[0], arrays[1], arrays[2].reshape(-1, width))
    return found


def correlations(df: DataFrame, width: int) -> DataFrame:
    """(i, j, correlation, rows) for all pairs i < j of the entries of ``v`` (array of double).

    Over the rows without a null or NaN; null where either entry is constant.
    """
    spark = df.sparkSession

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tile, part), m in _merged(batches, width, by_part=True).items():
            yield _batch([_as_rows(tile, part, m)])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tile, _), m in _merged(batches, width, by_part=False).items():
            at = _tiles(width)[tile]
            for i in range(at.start, at.stop):
                j = np.arange(i + 1, width)
                r, absent = np.zeros(len(j)), np.ones(len(j), bool)
                if m.n:
                    norm = np.sqrt(m.spread[i]) * np.sqrt(m.spread[j])
                    absent = norm == 0
                    r = np.clip(m.cross[i - at.start, j] / np.where(absent, 1.0, norm), -1.0, 1.0)
                yield pa.record_batch(
                    {
                        "i": pa.array(np.full(len(j), i), pa.int32()),
                        "j": pa.array(j, pa.int32()),
                        "correlation": pa.array(r, pa.float64(), mask=absent),
                        "rows": pa.array(np.full(len(j), m.n), pa.int64()),
                    }
                )

    # A row of nulls counts nothing, but makes even an empty table give its pairs.
    nothing = spark.range(1).select(F.array_repeat(F.lit(None).cast("double"), width).alias("v"))
    summed = df.select("v").unionByName(nothing).mapInArrow(_summed(width), PARTIAL)
    group = F.expr(f"part div {FAN_IN}").cast("int")
    some_of = summed.withColumn("part", group).repartition("tile", "part").mapInArrow(some, PARTIAL)
    return some_of.repartition("tile").mapInArrow(final, "i int, j int, correlation double, rows bigint")


def against_first(df: DataFrame, width: int) -> DataFrame:
    """(i, correlation, rows) of each entry i >= 1 of ``v`` with entry 0, over the rows where both are known.

    Null where either is constant there.
    """
    names = ("n", "mean_x", "mean_y", "xx", "yy", "xy")

    def merged(parts: Iterable[tuple]) -> tuple:
        total = None
        for part in parts:
            if total is None:
                total = part
                continue
            (n1, x1, y1, xx1, yy1, xy1), (n2, x2, y2, xx2, yy2, xy2) = total, part
            both = n1 + n2
            share = np.divide(n2, both, out=np.zeros_like(both), where=both > 0)
            gx, gy, weight = np.where(n2 > 0, x2 - x1, 0.0), np.where(n2 > 0, y2 - y1, 0.0), n1 * share
            # An empty side has means of zero, and takes over those of the other: its weight is nothing.
            total = (
                both, x1 + gx * share, y1 + gy * share,
                xx1 + xx2 + gx * gx * weight, yy1 + yy2 + gy * gy * weight, xy1 + xy2 + gx * gy * weight,
            )
        return total if total is not None else tuple(np.zeros(width - 1) for _ in names)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        base = None
        for batch in batches:
            v = _matrix(batch, width)
            if not len(v):
                continue
            if base is None:
                first = np.isnan(v).argmin(axis=0)
                base = np.nan_to_num(v[first, np.arange(width)])
            v = v - base
            x, y = v[:, 1:], v[:, :1]
            known = ~np.isnan(x) & ~np.isnan(y)
            x, y = np.where(known, x, 0.0), np.where(known, y, 0.0)
            n = known.sum(axis=0).astype(float)
            mean_x, mean_y = (a.sum(axis=0) / np.maximum(n, 1) for a in (x, y))
            x, y = np.where(known, x - mean_x, 0.0), np.where(known, y - mean_y, 0.0)
            held = n > 0
            yield (
                n, np.where(held, mean_x + base[1:], 0.0), np.where(held, mean_y + base[0], 0.0),
                (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0),
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = merged(summaries(batches))
        yield pa.record_batch({name: pa.array([np.ascontiguousarray(a).tobytes()]) for name, a in zip(names, total, strict=True)})

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(np.frombuffer(row[name]) for name in names) for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        n, _, _, xx, yy, xy = merged([first, *rows])
        norm = np.sqrt(xx) * np.sqrt(yy)
        absent = norm == 0
        r = np.clip(xy / np.where(absent, 1.0, norm), -1.0, 1.0)
        yield pa.record_batch(
            {
                "i": pa.array(np.arange(1, width), pa.int32()),
                "correlation": pa.array(r, pa.float64(), mask=absent),
                "rows": pa.array(n.astype(np.int64), pa.int64()),
            }
        )

    nothing = df.sparkSession.range(1).select(F.array_repeat(F.lit(None).cast("double"), width).alias("v"))
    parts = df.select("v").unionByName(nothing).mapInArrow(summed, ", ".join(f"{name} binary" for name in names))
    # One short row a task.
    return parts.repartition(1).mapInArrow(final, "i int, correlation double, rows bigint")
