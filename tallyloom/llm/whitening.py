"""Embedding whitening with MLlib's block matrices.

Vectors become integers on a grid, so that sums are exact however rows are partitioned. Centred rows get consecutive numbers
and become a distributed BlockMatrix; its transpose times itself is the scatter matrix. Only that matrix, a row and a column
per dimension, reaches the driver, which takes its eigenvectors. A second block product projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Steps of the grid a unit, and the offset that keeps usual entries positive.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLS = 1024, 256
#: Row blocks that one task multiplies.
BLOCKS_A_TASK = 16
#: Components with a smaller share of the largest eigenvalue are left out: their rows have no spread.
LEAST_SHARE = 1e-12
#: monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits.
PLACE_BITS = 33


@dataclass(frozen=True)
class Whitening:
    """``x - S / n`` times ``matrix`` (dimensions by components) gives whitened rows."""

    n: int
    sums: list[int]
    eigenvalues: list[float]
    trace: float
    matrix: np.ndarray


def on_grid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``x`` (array of long) and ``at`` (0, 1, ...) of the rows with a usable vector, stored.

    * Rows go whose vector is null, empty, or holds a null or an entry that is not finite.
    * Vectors of another length than most rows have go too, as they can't be compared (of equally frequent lengths the larger stays).
    * Ids may be null or repeated; every row stays a row.
    * An entry too large for a long raises an error (from 2^57 on).
    """
    entry = F.col("v")
    usable = F.size("v") > 0
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        entry.isNotNull() & usable & F.coalesce(sound, F.lit(False))
    )
    rows = rows.select("id", F.transform("v", lambda e: F.floor(e * SCALE).cast("bigint") + OFFSET).alias("x"))
    stored = materialise(rows.withColumn("_spot", F.monotonically_increasing_id()), "grid")
    length = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if length is None:
        return stored.select("id", "x", F.col("_spot").alias("at"))
    kept = stored.where(F.size("x") == length.d).withColumn("_part", F.shiftright("_spot", PLACE_BITS).cast("int"))
    # Places inside a partition are consecutive among the kept rows, too, once they are counted.
    if stored.where(F.size("x") != length.d).limit(1).count():
        kept = materialise(kept.drop("_spot").withColumn("_spot", F.monotonically_increasing_id()), "grid-kept")
        kept = kept.withColumn("_part", F.shiftright("_spot", PLACE_BITS).cast("int"))
    spans = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_spot").alias("_first"))
    # A row a partition.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = kept.join(F.broadcast(spans), "_part").select("id", "x", (F.col("_spot") + F.col("_shift")).alias("at"))
    return materialise(numbered, "grid-rows")


def entry_sums(rows: DataFrame, vector_col: str) -> list:
    """The sum of every entry, a row a dimension on the driver; summed inside the tasks first."""
    long = rows.select(F.posexplode(vector_col).alias("k", "e")).groupBy("k").agg(F.sum("e").alias("s"))
    return [r.s for r in sorted(long.collect())]


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows of (at, v) as distributed blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLS, width))


def times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product; sums over the inner dimension are shared among ``splits`` tasks a block of the result."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def scatter(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum of outer products of rows of (at, v), which have been centred."""
    a = block_matrix(rows, n, width)
    blocks = -(-n // BLOCK_ROWS)
    square = times(a.transpose(), a, max(1, -(-blocks // BLOCKS_A_TASK)))
    return square.toLocalMatrix().toArray()


def centred(grid: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(at, v): every entry as ``(n * x - S) / n``, exact before the division."""
    of = F.array(*[F.lit(s).cast("bigint") for s in sums])
    return grid.select("at", F.zip_with("x", of, lambda x, s: (x * n - s).cast("double") / float(n)).alias("v"))


def fit(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``on_grid`` rows; None if there are none.

    Eigenvectors come by falling eigenvalue. Components without any spread (a constant dimension, fewer rows than dimensions)
    are left out.
    """
    sums = entry_sums(grid, "x")
    if not sums:
        return None
    n = grid.count()
    covariance = scatter(centred(grid, n, sums), n, len(sums)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = [i for i in order if values[i] > 0 and values[i] >= LEAST_SHARE * values.max()]
    return Whitening(n, sums, [float(values[i]) for i in order], float(np.trace(covariance)), vectors[:, order] / np.sqrt(values[order]))


def whiten(grid: DataFrame, model: Whitening) -> DataFrame:
    """(at, w): the whitened rows, ``w`` with an entry a component; stored."""
    spark, width = grid.sparkSession, len(model.sums)
    n_out = model.matrix.shape[1]
    if not n_out:
        return grid.select("at", F.array().cast("array<double>").alias("w"))
    a = block_matrix(centred(grid, model.n, model.sums), model.n, width)
    cols = min(BLOCK_COLS, n_out)
    parts = []
    for i in range(0, width, a.colsPerBlock):
        for j in range(0, n_out, cols):
            block = model.matrix[i : i + a.colsPerBlock, j : j + cols]
            parts.append(((i // a.colsPerBlock, j // cols), DenseMatrix(*block.shape, block.ravel(order="F"))))
    b = BlockMatrix(spark.sparkContext.parallelize(parts, 1), a.colsPerBlock, cols, width, n_out)
    projected = times(a, b).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    return materialise(rows.select(F.col("index").alias("at"), vector_to_array("vector").alias("w")), "whitened")


def identity_error(whitened: DataFrame, n: int) -> float:
    """The largest difference between the covariance of the whitened rows and the identity."""
    sums = entry_sums(whitened, "w")
    if not sums:
        return 0.0
    means = F.array(*[F.lit(s / n) for s in sums])
    rows = whitened.select("at", F.zip_with("w", means, lambda w, m: w - m).alias("v"))
    covariance = scatter(rows, n, len(sums)) / n
    return float(np.abs(covariance - np.eye(len(sums))).max())
