"""K-means for many numbers of clusters and many starts at once.

All models read the same rows in the same pass: their centres are stacked into one matrix, and one aggregate keyed by model and
centre gives the next centres of all of them. A sweep over seven k with ten starts takes as many passes as its slowest model has
iterations, not seventy times that. The driver holds centres only.

Rows are stored in cells of neighbours, cells in groups, each with its box, sums and scatter. Where one centre is nearest to the
whole box of a group or cell, its sums are taken as they are; only rows of boxes that lie between centres are looked at one by
one. Every row counts in every pass, and sizes are those of the plain method; sums differ from it by rounding only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import scratch_path

MAX_ITERATIONS, TOLERANCE = 100, 1e-4
#: Rows of a cell, about, and cells of a group.
CELL, GROUP = 16, 16
#: Most numbers of the rows that are put into cells together, of those that are stored in one block, and of those that a task
#: works on at once. Large blocks are slow to read, as the JVM copies each several times.
SORTED, BLOCK, JOINED = 1 << 22, 1 << 15, 1 << 19
#: Blocks that are read and sent to a Python worker together, and bytes of a file that are read together.
SENT, READ = 16, 8 << 20
#: Coordinates of all centres of a model up to which distances are written out, so that they are compiled.
WRITTEN_OUT = 200
#: Rows that are worked on at once, so that what comes between stays in a core's cache.
RUN = 2048


@dataclass
class Centres:
    """A model: its centres, how many rows are nearest to each, and the total squared distance."""

    k: int
    points: np.ndarray
    sizes: np.ndarray
    cost: float

    def nearest(self, vector: Column) -> Column:
        """The number of the centre nearest to an array; of equally near ones the first."""

        def distance(centre: np.ndarray) -> Column:
            if self.points.size <= WRITTEN_OUT:
                gaps = [vector[i] - F.lit(float(c)) for i, c in enumerate(centre)]
                return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
            gaps = F.zip_with(vector, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b))
            return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)

        ranked = [F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.points)]
        return F.array_min(F.array(*ranked))["i"]


ROWS = "width int, cells int, size int, h binary, x binary, nodes binary"


def rows_of(points: DataFrame, key: str) -> DataFrame:
    """Hashes of the keys and the vectors, stored in blocks of cells, as every pass reads them."""
    plain = points.select(F.xxhash64(key).alias("h"), vector_to_array("vector").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                h, v = batch.column("h").to_numpy(), batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                held.append((h, v))
                rows += len(h)
                if rows * (v.shape[1] + 1) >= SORTED:
                    yield from _packed(*map(np.concatenate, zip(*held)))
                    held, rows = [], 0
        if held:
            yield from _packed(*map(np.concatenate, zip(*held)))

    path = scratch_path(points.sparkSession, "lloyd-rows")
    # A block is large: without the checks the writer looks at its size after a hundred of them only.
    sizes = {"parquet.block.size": str(READ)} | {f"parquet.{part}.size.row.check.min": "1" for part in ("page", "block")}
    plain.mapInArrow(packed, ROWS).write.options(compression="none", **sizes).parquet(path)
    return points.sparkSession.read.schema(ROWS).parquet(path)


def _sorted_into_cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (by column, cell and place) and the number of the row at each place, cells being halved at their widest side.

    All cells are equally large and a power of two in number; what is left over is filled with numbers beyond the rows, at
    coordinates of rows.
    """
    n, width = x.shape
    depth = max(0, round(math.log2(n / CELL)))
    size = -(-n // (1 << depth))
    number = np.arange(size << depth)[None]
    at = np.take(x.T, number % n, axis=1)
    for _ in range(depth):
        widest = (at.max(axis=2) - at.min(axis=2)).argmax(axis=0)
        half = number.shape[1] // 2
        order = at[widest, np.arange(len(widest))].argpartition(half, axis=1)
        number = np.take_along_axis(number, order, axis=1).reshape(-1, half)
        at = np.take_along_axis(at, order[None], axis=2).reshape(width, -1, half)
    return at, number


def _node_facts(at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """By column, for nodes of (column, node, place): middle and half sides of the box, sums, rows, scatter about the mean."""
    low, high, weight = at.min(axis=2), at.max(axis=2), known.astype(float)
    n = weight.sum(axis=1)
    sums = (at * weight).sum(axis=2)
    gaps = at - (sums / np.maximum(n, 1))[:, :, None]
    scatter = (gaps * gaps * weight).sum(axis=(0, 2))
    return np.concatenate([(low + high) / 2, (high - low) / 2, sums, [n, scatter]])


def _packed(h: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = v.shape[1]
    at, number = _sorted_into_cells(v)
    cells, size = number.shape
    each = min(cells, 1 << max(0, int(math.log2(max(1, BLOCK // ((width + 1) * size))))))
    for low in range(0, cells, each):
        own, part = number[low : low + each], at[:, low : low + each]
        known, grouped = own < len(h), max(each // GROUP, 1)
        groups = _node_facts(part.reshape(width, grouped, -1), known.reshape(grouped, -1))
        nodes = np.concatenate([groups.reshape(-1), _node_facts(part, known).reshape(-1)])
        # A one beside the coordinates of a row; places without a row are all zeros and add nothing to any sum.
        x = np.concatenate([part * known, known[None]])
        row = [width, each, size, np.where(known, h[own % len(h)], 0).tobytes(), x.tobytes(), nodes.tobytes()]
        types = [pa.int32()] * 3 + [pa.binary()] * 3
        yield pa.record_batch([pa.array([c], t) for c, t in zip(row, types)], ["width", "cells", "size", "h", "x", "nodes"])


@dataclass
class _Nodes:
    """Groups or cells, a column each: middles with a one below, half sides, (sums, rows), scatter."""

    middle: np.ndarray
    side: np.ndarray
    total: np.ndarray
    scatter: np.ndarray


@dataclass
class _Block:
    """``x`` by coordinate (the last is one), cell and place; ``levels`` from groups to cells."""

    x: np.ndarray
    levels: list[_Nodes]
    h: np.ndarray | None

    def rows(self) -> np.ndarray:
        flat = self.x.reshape(len(self.x), -1)
        return flat[:, flat[-1] > 0]

    def reach(self) -> np.ndarray:
        """The largest size of each coordinate in the block."""
        return (np.abs(self.levels[0].middle[:-1]) + self.levels[0].side).max(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """The stored blocks; those that follow each other and have equal cells are joined."""
    held, shape, values = [], None, 0
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            new = tuple(columns[c][i].as_py() for c in ("width", "cells", "size"))
            if held and (new != shape or values >= JOINED):
                yield _joined(held, *shape)
                held, values = [], 0
            held.append([np.frombuffer(columns[c][i].as_buffer(), t) for c, t in (("x", float), ("nodes", float), ("h", "int64")) if c in columns])
            shape, values = new, values + len(held[-1][0])
    if held:
        yield _joined(held, *shape)


def _joined(parts: list[list[np.ndarray]], width: int, cells: int, size: int) -> _Block:
    x = np.concatenate([p[0].reshape(width + 1, cells, size) for p in parts], axis=1)
    levels, start = [], 0
    for count in (max(cells // GROUP, 1), cells):
        end = start + (3 * width + 2) * count
        own = np.concatenate([p[1][start:end].reshape(-1, count) for p in parts], axis=1)
        middle = np.concatenate([own[:width], np.ones((1, own.shape[1]))])
        levels.append(_Nodes(middle, own[width : 2 * width], own[2 * width : 3 * width + 1], own[-1]))
        start = end
    return _Block(x, levels, np.concatenate([p[2] for p in parts]) if len(parts[0]) > 2 else None)


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs in the block read few rows at once and send few to Python, as a row is a whole block."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(SENT))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _bits(h: np.ndarray, salt: int) -> np.ndarray:
    """53 bits for each hash, others for each salt, whatever the partitioning."""
    x = h.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 53 bits."""
    return bits.astype(float) * 2.0**-53 + 2.0**-54


def _least_bits(time: float) -> int:
    """At least these bits have rows whose number's negative logarithm is ``time`` or less."""
    return max(0, math.floor(math.exp(-time * (1 + 1e-9)) * 2.0**53) - 4)


def starts(rows: DataFrame, width: int, most: int, restarts: int, seed: int) -> list[np.ndarray]:
    """For each restart ``most`` rows as first centres, drawn one after the other with weights of squared distance to those before.

    All restarts draw in the same pass over all rows: every row runs a race with exponential times, and the fastest is drawn.
    Fewer are returned where fewer different rows exist.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(most):
        so_far = [np.array(c) for c in chosen]

        def race(batches: Iterator[pa.RecordBatch], so_far=so_far, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for block in _blocks(batches):
                x, middle, side = block.x.reshape(width + 1, -1), block.levels[0].middle[:-1], block.levels[0].side
                # No row of the block weighs more than this.
                heaviest = [
                    1.0 if not step else min(((np.abs(middle - c[:, None]) + side) ** 2).sum(axis=0).max() for c in centres)
                    for centres in so_far
                ]
                for low in range(0, len(block.h), 8 * RUN):
                    h, known = block.h[low : low + 8 * RUN], x[-1, low : low + 8 * RUN] > 0
                    for r, centres in enumerate(so_far):
                        bits = _bits(h, seed + 1000 * r + step)
                        # Rows that could not be faster however much they weighed are passed over.
                        least = _least_bits(best[r][0] * heaviest[r]) if r in best else 0
                        runs = np.flatnonzero((bits >= np.uint64(least)) & known)
                        if not len(runs):
                            continue
                        at = np.ascontiguousarray(x[:-1, low + runs].T)
                        # Coordinates, not products: a row equal to a centre must have no weight at all.
                        weight = np.ones(len(at)) if not step else np.min([np.einsum("ij,ij->i", at - c, at - c) for c in centres], axis=0)
                        with np.errstate(divide="ignore"):
                            time = -np.log(_uniform(bits[runs])) / weight
                        i = int(time.argmin())
                        if np.isfinite(time[i]) and (r not in best or (time[i], h[runs[i]]) < best[r][:2]):
                            best[r] = (float(time[i]), int(h[runs[i]]), at[i].tolist())
            yield pa.record_batch(
                {
                    "restart": pa.array(list(best), pa.int32()),
                    "time": pa.array([b[0] for b in best.values()], pa.float64()),
                    "h": pa.array([b[1] for b in best.values()], pa.int64()),
                    "v": pa.array([b[2] for b in best.values()], pa.list_(pa.float64())),
                }
            )

        drawn = rows.mapInArrow(race, "restart int, time double, h bigint, v array<double>")
        with _few_at_once(rows.sparkSession):
            fastest = drawn.groupBy("restart").agg(F.min_by("v", F.struct("time", "h")).alias("v")).collect()
        for row in fastest:
            chosen[row["restart"]].append(np.array(row["v"]))
    return [np.array(c).reshape(-1, width) for c in chosen]


def _nearest(distance: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which centre of its model each row is nearest to: ones and zeros by centre and row; of equally near centres the first.

    Centres run down and rows across, so that every step works on a long run of rows.
    """
    own = np.empty(distance.shape)
    for a, b in zip(edges[:-1], edges[1:]):
        np.equal(distance[a:b], np.minimum.reduce(distance[a:b], axis=0), out=own[a:b], casting="unsafe")
    if own.sum() > (len(edges) - 1) * distance.shape[1]:
        for a, b in zip(edges[:-1], edges[1:]):
            taken = np.zeros(distance.shape[1])
            for c in range(a, b):
                own[c] *= 1.0 - taken
                taken += own[c]
    return own


def _decided(model: np.ndarray, factors: np.ndarray, nodes: _Nodes, some: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre to the middle of each node, and whether it is the nearest in the whole box. What one centre is
    farther than another by is linear, so that its least value in a box follows from the sides. ``slack`` covers rounding."""
    distance, side = factors @ nodes.middle[:, some], nodes.side[:, some]
    own = distance.argmin(axis=0)
    sure = np.empty(len(own), bool)
    for c, centre in enumerate(model):
        at = np.flatnonzero(own == c)
        if len(at):
            need = (2 * np.abs(model - centre)) @ side.take(at, axis=1) + slack
            need[c] = -1.0
            sure[at] = np.logical_and.reduce(distance.take(at, axis=1) - distance[c].take(at) > need, axis=0)
    return own, sure


def _add_rows(part: np.ndarray, factors: np.ndarray, edges: np.ndarray, sums: np.ndarray, cost: np.ndarray | None) -> None:
    """Add the rows, one by one, to the sums of their centres."""
    for low in range(0, part.shape[1], RUN):
        x = part[:, low : low + RUN]
        distance = factors @ x
        own = _nearest(distance, edges)
        sums += own @ x.T
        if cost is not None:
            distance += (x[:-1] * x[:-1]).sum(axis=0)
            cost += (own * np.maximum(distance, 0.0)).sum(axis=1)


def _totals(rows: DataFrame, width: int, models: list[np.ndarray], costs: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes, sums and, where asked for, squared distances of the centres of all models, in one pass."""
    edges = np.cumsum([0, *[len(m) for m in models]])
    stacked = np.concatenate(models)
    # One product gives |c|^2 - 2xc, another adds up the rows of each centre and counts them.
    factors = np.column_stack([-2 * stacked, (stacked * stacked).sum(axis=1)])

    def settled(block: _Block, a: int, b: int, slack: float) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """(centre, sums and rows, scatter) of the nodes that are decided for a model, level by level, and the cells that are not."""
        found, some = [], np.arange(len(block.levels[0].scatter))
        for depth, nodes in enumerate(block.levels):
            own, sure = _decided(stacked[a:b], factors[a:b], nodes, some, slack)
            found.append((own[sure], nodes.total[:, some[sure]], nodes.scatter[some[sure]]))
            some = some[~sure]
            if not depth:
                each = block.x.shape[1] // len(nodes.scatter)
                some = (some[:, None] * each + np.arange(each)).reshape(-1)
        return found, some

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cost = np.zeros((len(stacked), width + 1)), np.zeros(len(stacked))
        for block in _blocks(batches):
            slack = (width + 4) * 1e-15 * (float(factors[:, -1].max()) + float((block.reach() ** 2).sum()))
            mixed = []
            for m, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                found, some = settled(block, a, b, slack)
                if 2 * len(some) > block.x.shape[1]:
                    mixed.append(m)
                    continue
                for own, total, scatter in found:
                    for i in range(width + 1):
                        sums[a:b, i] += np.bincount(own, total[i], b - a)
                    if costs:
                        gaps = total[:-1] / np.maximum(total[-1], 1) - stacked[a:b][own].T
                        cost[a:b] += np.bincount(own, scatter + total[-1] * (gaps * gaps).sum(axis=0), b - a)
                if len(some):
                    part = np.take(block.x, some, axis=1).reshape(width + 1, -1)
                    _add_rows(part[:, part[-1] > 0], factors[a:b], edges[m : m + 2] - a, sums[a:b], cost[a:b] if costs else None)
            if mixed:
                # Models of which most boxes lie between centres take all rows, in one product.
                at = np.concatenate([np.arange(edges[m], edges[m + 1]) for m in mixed])
                of = np.cumsum([0, *[edges[m + 1] - edges[m] for m in mixed]])
                more, extra = np.zeros((len(at), width + 1)), np.zeros(len(at))
                _add_rows(block.rows(), factors[at], of, more, extra if costs else None)
                sums[at] += more
                cost[at] += extra
        columns = {"centre": pa.array(np.arange(len(stacked)), pa.int32()), "n": pa.array(sums[:, width]), "cost": pa.array(cost)}
        yield pa.record_batch(columns | {f"s{i}": pa.array(sums[:, i]) for i in range(width)})

    names = ["n", "cost", *[f"s{i}" for i in range(width)]]
    found = rows.drop("h").mapInArrow(assign, "centre int, " + ", ".join(f"{c} double" for c in names))
    totals = np.zeros((len(stacked), len(names)))
    with _few_at_once(rows.sparkSession):
        summed = found.groupBy("centre").agg(*[F.sum(c).alias(c) for c in names]).collect()
    for row in summed:
        totals[row["centre"]] = row[1:]
    return [(totals[a:b, 0], totals[a:b, 2:], totals[a:b, 1]) for a, b in zip(edges[:-1], edges[1:])]


def _pass(rows: DataFrame, width: int, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes and sums of the centres of all models, for a step; only the last models need their squared distances."""
    return _totals(rows, width, models, costs=False)


def fit_all(rows: DataFrame, width: int, ks: Sequence[int], restarts: int, seed: int) -> dict[int, Centres]:
    """For each k the best of several starts by total squared distance; ``rows`` from ``rows_of``.

    A centre without rows stays where it is. A model is done when no centre moves further than ``TOLERANCE``.
    """
    first = starts(rows, width, max(ks), restarts, seed)
    models = [(k, start[:k]) for k in ks for start in first]
    done: list[tuple[int, np.ndarray]] = []
    for _ in range(MAX_ITERATIONS):
        if not models:
            break
        moved = []
        for (k, centres), (sizes, sums, _) in zip(models, _pass(rows, width, [c for _, c in models]), strict=True):
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
            still = ((new - centres) ** 2).sum(axis=1).max() > TOLERANCE**2
            (moved if still else done).append((k, new))
        models = moved
    done += models
    best: dict[int, Centres] = {}
    for (k, centres), (sizes, _, costs) in zip(done, _totals(rows, width, [c for _, c in done], costs=True), strict=True):
        if k not in best or costs.sum() < best[k].cost:
            best[k] = Centres(k, centres, sizes, float(costs.sum()))
    return best


def silhouettes(rows: DataFrame, width: int, models: Sequence[Centres]) -> list[float]:
    """Mean silhouettes under squared Euclidean distance, of all models in two passes; 0 with fewer than two clusters in use."""
    facts = []
    for model, (n, sums, costs) in zip(models, _totals(rows, width, [m.points for m in models], costs=True), strict=True):
        # Sum of squares of the rows of a cluster, from their squared distances to its centre.
        squares = costs + 2 * (sums * model.points).sum(axis=1) - n * (model.points**2).sum(axis=1)
        size, used = np.maximum(n, 1), n > 0
        centre = np.column_stack([-2 * model.points, (model.points**2).sum(axis=1)])
        # The mean squared distance of a row to a cluster, less the square of the row.
        mean = np.column_stack([-2 * sums / size[:, None], np.where(used, squares / size, np.inf)])
        facts.append((centre, mean, np.where(n > 1, size / np.maximum(size - 1, 1), 0.0), used.sum()))

    def scores(x: np.ndarray) -> Iterator[float]:
        square = (x[:-1] * x[:-1]).sum(axis=0)
        for centre, mean, more, used in facts:
            if used < 2:
                yield 0.0
                continue
            own = _nearest(centre @ x, np.array([0, len(centre)]))
            to = mean[:, :-1] @ x[:-1] + mean[:, -1:] + square
            several = more @ own
            inner = np.where(own > 0, to, 0.0).sum(axis=0) * several
            outer = np.where(own > 0, np.inf, to).min(axis=0)
            top = np.maximum(inner, outer)
            yield float((np.where(several > 0, outer - inner, 0.0) / np.where(top > 0, top, 1.0))[top > 0].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for block in _blocks(batches):
            x = block.rows()
            for low in range(0, x.shape[1], RUN):
                total += list(scores(x[:, low : low + RUN]))
        yield pa.record_batch({"i": pa.array(np.arange(len(models)), pa.int32()), "s": pa.array(total)})

    found = np.zeros(len(models))
    with _few_at_once(rows.sparkSession):
        summed = rows.drop("h").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    for row in summed:
        found[row["i"]] = row["s"]
    return [float(s / max(m.sizes.sum(), 1)) for s, m in zip(found, models, strict=True)]
