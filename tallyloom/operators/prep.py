"""Imputation, scaling and train/test splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.brackets import quantiles_of
from tallyloom.functions.exprs import known, one_row, quoted
from tallyloom.functions.ranking import global_rank, value_counts
from tallyloom.session import materialise


def _lookup(long: DataFrame, value: str) -> Column:
    """A (column_name, value) frame as one map; it has a row per column."""
    return long.agg(F.map_from_entries(F.collect_list(F.struct("column_name", value)))).scalar()


def impute_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls and NaN replaced by the column's exact median (the mean of the middle two), taken
    from ``fit_on`` where given. The columns are stored once, as brackets read them several times."""
    source = materialise((df if fit_on is None else fit_on).select(*columns), "medians")
    medians = _lookup(quantiles_of(source, columns, [0.5]), "quantile")
    return df.withColumns(
        {c: F.coalesce(known(F.col(c).cast("double")), F.try_element_at(medians, F.lit(c))) for c in columns}
    )


def impute_mode(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the most frequent value, the smallest on ties."""
    source = df if fit_on is None else fit_on
    long = source.selectExpr(*[f"cast({quoted(c)} AS string) AS {quoted(c)}" for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    modes = (
        value_counts(long, ["column_name"], "value")
        .groupBy("column_name")
        .agg(F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("mode"))
    )
    lookup = _lookup(modes, "mode")
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.try_element_at(lookup, F.lit(c)).cast(df.schema[c].dataType))
            for c in columns
        }
    )


def zscale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; constant columns become 0, NaN null."""
    source = df if fit_on is None else fit_on
    sums = []
    for i, c in enumerate(columns):
        value = known(F.col(c).cast("double"))
        sums += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    moments = one_row(source.agg(*sums))
    scaled = {}
    for i, c in enumerate(columns):
        spread = F.when(moments[f"s{i}"] > 0, moments[f"s{i}"]).otherwise(F.lit(1.0))
        scaled[c] = (known(F.col(c).cast("double")) - moments[f"m{i}"]) / spread
    return df.withColumns(scaled)


def split_order(key: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows that depends on the key alone."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(
    df: DataFrame, key: str, target: str | None = None, train: float = 0.8, seed: int = 42
) -> DataFrame:
    """Add ``is_train``: the first 80 % of each class in hash order.

    The same rows are chosen whatever the partitioning. Classes are ranked by the
    distributed ranking, so one class may hold most rows.
    """
    group = [target] if target else []
    slim = df.select(F.col(key), *group, split_order(key, seed).alias("_order"))
    ranked = global_rank(slim, "_order", [key], group)
    flags = ranked.select(F.col(key), (F.col("rank") <= F.floor(F.col("n") * F.lit(train))).alias("is_train"))
    return df.join(flags, key)


def random_rows(df: DataFrame, key: str, k: int = 500, seed: int = 42) -> DataFrame:
    """k rows without replacement, the same ones on every run."""
    return df.withColumn("_order", split_order(key, seed)).orderBy("_order", key).limit(k).drop("_order")
