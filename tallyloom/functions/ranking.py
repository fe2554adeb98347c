"""Global ranks, running totals and exact quantiles without a single-task sort.

``row_number().over(orderBy(...))`` sends every row to one task, and Spark's
``percentile`` holds every distinct value in one aggregation buffer. Here rows are
range-partitioned on the full sort key (value, then a unique key), so that even a
value shared by a third of the rows is split over many partitions. Each partition
counts its own rows, and the short list of per-partition totals supplies the
offsets. That list has one row per partition and group and is the only thing
broadcast.

``group`` columns here are few (metric names, columns of a table, classes). For
ranks inside many small groups use an ordinary window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exprs import known
from tallyloom.session import materialise

# monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits.
PLACE_BITS = 33
# Places of a partition that share all but the low 12 bits form a bin.
BIN_BITS = 12


def _spread(df: DataFrame, order: Sequence[Column | str], label: str) -> DataFrame:
    """Range-partition and sort by ``order``; store partition and place per row."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_spot", F.monotonically_increasing_id()
    )
    spread = spread.withColumns(
        {
            "_part": F.shiftright("_spot", PLACE_BITS).cast("int"),
            "_place": F.col("_spot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
        }
    ).drop("_spot")
    return materialise(spread, label)


def _before(group: Sequence[str], amount: str, order: Sequence[str] = ("_part",)) -> Column:
    """Sum of ``amount`` over the earlier partitions of the same group."""
    window = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def global_rank(
    df: DataFrame,
    value: str,
    key: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``rank`` (1..n, ties by ``key`` ascending) and ``n`` per group."""
    group = list(group)
    first = F.desc(value) if descending else F.asc(value)
    stored = _spread(df, [*group, first, *key], "rank")
    spans = stored.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    spans = spans.withColumns(
        {"_offset": _before(group, "_rows"), "n": F.sum("_rows").over(W.partitionBy(*group))}
    ).drop("_rows")
    return (
        stored.join(F.broadcast(spans), [*group, "_part"])
        .withColumn("rank", F.col("_place") - F.col("_first") + F.col("_offset") + 1)
        .drop("_part", "_place", "_first", "_offset")
    )


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct (group, value); map-side combined, so hot values are cheap."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("rows"))


def running_counts(counts: DataFrame, group: Sequence[str], value: str, rows: str = "rows") -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``n`` to a value-count table."""
    group = list(group)
    stored = _spread(counts, [*group, value], "running")
    spans = stored.groupBy(*group, "_part").agg(F.sum(rows).alias("_rows"))
    spans = spans.withColumns(
        {"_offset": _before(group, "_rows"), "n": F.sum("_rows").over(W.partitionBy(*group))}
    ).drop("_rows")
    inside = W.partitionBy(*group, "_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    return (
        stored.withColumn("_inner", F.coalesce(F.sum(rows).over(inside), F.lit(0)))
        .join(F.broadcast(spans), [*group, "_part"])
        .withColumn("below", F.col("_inner") + F.col("_offset"))
        .drop("_part", "_place", "_inner", "_offset")
    )


def running_sums(df: DataFrame, order: str, amounts: Sequence[str]) -> DataFrame:
    """Add ``<amount>_upto``: the sum of each amount over all rows up to this one. ``order`` must differ from row to row."""
    stored = _spread(df, [order], "running-sums")
    spans = stored.groupBy("_part").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    spans = spans.select("_part", *[_before([], f"_{a}").alias(f"_{a}") for a in amounts])
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = stored.withColumns({f"{a}_upto": F.sum(a).over(inside) for a in amounts}).join(F.broadcast(spans), "_part")
    return inner.withColumns({f"{a}_upto": F.col(f"{a}_upto") + F.col(f"_{a}") for a in amounts}).drop("_part", "_place", *[f"_{a}" for a in amounts])


def exact_quantiles(
    counts: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], rows: str = "rows"
) -> DataFrame:
    """Linear-interpolation quantiles from a value-count table.

    Returns (group, probability, quantile, n). Partitions are cut into bins of 4096
    places, and only the bins that hold a wanted position are shuffled and sorted.
    """
    group = list(group)
    stored = _spread(counts.select(*group, value, rows), [*group, value], "quantile")
    stored = stored.withColumn("_bin", F.shiftright("_place", BIN_BITS))
    spans = stored.groupBy(*group, "_part", "_bin").agg(F.sum(rows).alias("_rows"))
    spans = spans.withColumns(
        {"_offset": _before(group, "_rows", ("_part", "_bin")), "n": F.sum("_rows").over(W.partitionBy(*group))}
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    hits = (
        spans.withColumn("probability", wanted)
        .withColumn("_at", (F.col("n") - 1) * F.col("probability"))
        .withColumn("_side", F.explode(F.array(F.floor("_at"), F.ceil("_at"))))
        .where((F.col("_side") >= F.col("_offset")) & (F.col("_side") < F.col("_offset") + F.col("_rows")))
        .select(*group, "_part", "_bin", "_offset", "n", "probability", "_at", "_side")
        .distinct()
    )
    places = hits.select(*group, "_part", "_bin").distinct()
    inside = W.partitionBy(*group, "_part", "_bin").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    near = stored.join(F.broadcast(places), [*group, "_part", "_bin"]).withColumn(
        "_inner", F.coalesce(F.sum(rows).over(inside), F.lit(0))
    )
    place = F.col("_side") - F.col("_offset")
    found = near.join(F.broadcast(hits), [*group, "_part", "_bin"]).where(
        (place >= F.col("_inner")) & (place < F.col("_inner") + F.col(rows))
    )
    low = F.min_by(value, "_side").cast("double")
    high = F.max_by(value, "_side").cast("double")
    share = F.max("_at") - F.min("_side")
    return found.groupBy(*group, "probability").agg(
        (low + (high - low) * share).alias("quantile"), F.max("n").alias("n")
    )


def long_counts(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Value-count table (extra..., column_name, value, rows) of numeric columns, without NaN."""
    long = df.select(*extra, *[known(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(
        list(extra), list(columns), "column_name", "value"
    )
    return value_counts(long, [*extra, "column_name"], "value")


def rows_below(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_below`` and ``<column>_ties`` (rows under and at the value) and
    ``n``. Looked up by value in a distinct-value table, stored once, column by column; small
    tables are broadcast and hot values split by adaptive execution."""
    ranks = materialise(running_counts(long_counts(df, columns), ["column_name"], "value"), "ranks")
    for column in columns:
        lookup = ranks.where(F.col("column_name") == column).select(
            F.col("value").alias(f"_{column}"),
            F.col("below").alias(f"{column}_below"),
            F.col("rows").alias(f"{column}_ties"),
            F.col("n").alias(f"_{column}_n"),
        )
        df = df.join(lookup, F.col(column).cast("double") == F.col(f"_{column}"), "left").drop(f"_{column}")
    return df.withColumn("n", F.col(f"_{columns[0]}_n")).drop(*[f"_{c}_n" for c in columns])


def quintile_by_rank(rank: Column, n: Column) -> Column:
    """Fifth (1..5) of a row in a total order of ``n`` rows.

    Cut points sit at linear-interpolation quantiles of the ranks 1..n and the
    upper edge belongs to the lower fifth, so the rank alone decides.
    """
    spans = F.greatest(n - 1, F.lit(1))
    fifth = F.floor(((rank - 1) * 5 + n - 2) / spans).cast("int")
    return F.when(n == 1, F.lit(1)).otherwise(F.greatest(fifth, F.lit(1)))


def quintile_by_share(below: Column, n: Column) -> Column:
    """Fifth of a value from the share of rows strictly below it; the maximum is 5."""
    spans = F.greatest(n - 1, F.lit(1))
    return (F.floor(below * 4 / spans) + 1).cast("int")


def quintile_by_edges(value: Column, edges: Column) -> Column:
    """1 + number of the four inner edges that lie below the value."""
    score = F.lit(1)
    for i in range(4):
        score = score + (value > edges[i]).cast("int")
    return score
