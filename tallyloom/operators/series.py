"""Rolling metrics, seasonal decomposition, forecasts and outliers.

One long series is never ordered in a single task: rows get their rank from a range shuffle and are cut into blocks that overlap
by a window, or become marks whose running totals come from per-partition sums. Many short series (a row a day) are windows or
arrays of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exprs import known
from tallyloom.functions.ranking import global_rank, running_sums

#: Rows of a block of one long series.
BLOCK_ROWS = 100_000
#: Decimals to which values are summed where sums must not drift.
EXACT = "decimal(38,9)"
ALPHAS, BETAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.1, 0.3, 0.5)


# --- rolling metrics of one long series --------------------------------------


def rolling_rows(df: DataFrame, order: str, key: str, value: str, rows: int) -> DataFrame:
    """``df`` with ``window_rows``, ``rolling_mean``, ``rolling_min`` and ``rolling_max`` over each row and the ``rows`` - 1 before
    it, in the order of ``order``, ties by ``key``. Missing values are skipped.

    Blocks of consecutive ranks are windows of their own; each gets the last rows of the block before.
    """
    size = max(BLOCK_ROWS, rows)
    place = F.col("rank") - 1
    block = F.floor(place / size)
    late = place % size >= size - (rows - 1)
    placed = global_rank(df, order, [key]).drop("n").withColumn("_own", block)
    spread = placed.withColumn("_block", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    window = W.partitionBy("_block").orderBy("rank").rowsBetween(-(rows - 1), 0)
    x = known(F.col(value).cast("double"))
    rolled = spread.withColumns(
        {
            "window_rows": F.count(x).over(window),
            "rolling_mean": F.avg(x).over(window),
            "rolling_min": F.min(x).over(window),
            "rolling_max": F.max(x).over(window),
        }
    )
    return rolled.where("_block = _own").drop("_block", "_own", "rank")


def rolling_time(df: DataFrame, time: str, value: str, span: str) -> DataFrame:
    """(time, window_rows, rolling_sum, rolling_mean) at each different time, over the rows later than ``span`` before it and up
    to it; ``span`` is an interval such as ``7 days``.

    A row counts from its time on and no longer from ``span`` later on, so that running totals over these marks are the rolling
    sums, however many rows a span holds. Values are summed to nine decimals, exactly; missing ones don't count.
    """
    x = known(F.col(value).cast("double"))
    own = df.where(F.col(time).isNotNull() & x.isNotNull()).groupBy(F.col(time).alias("time"))
    own = own.agg(F.count(F.lit(1)).alias("n"), F.sum(x.cast(EXACT)).cast(EXACT).alias("s"))
    ends = own.select((F.col("time") + F.expr(f"INTERVAL {span}")).alias("time"), (-F.col("n")).alias("n"), (-F.col("s")).alias("s"))
    marks = own.withColumn("here", F.lit(1)).unionByName(ends.withColumn("here", F.lit(0)))
    marks = marks.groupBy("time").agg(F.sum("n").alias("n"), F.sum("s").cast(EXACT).alias("s"), F.max("here").alias("here"))
    totals = running_sums(marks, "time", ["n", "s"]).where("here = 1")
    total = F.col("s_upto").cast("double")
    return totals.select("time", F.col("n_upto").alias("window_rows"), total.alias("rolling_sum"), (total / F.col("n_upto")).alias("rolling_mean"))


# --- series of days ----------------------------------------------------------


def daily(df: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """(series, day, x): the sum of each day from a series' first to its last, 0 where there was nothing."""
    rows = df.where(F.col(series).isNotNull() & F.col(time).isNotNull())
    days = rows.groupBy(F.col(series).alias("series"), F.to_date(time).alias("day")).agg(
        F.coalesce(F.sum(known(F.col(value).cast("double")).cast(EXACT)), F.lit(0)).cast("double").alias("x")
    )
    ends = days.groupBy("series").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    spine = ends.select("series", F.explode(F.sequence("first", "last")).alias("day"))
    return spine.join(days, ["series", "day"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def decompose(days: DataFrame, period: int, robust: bool = False) -> DataFrame:
    """(series, day, x, trend, seasonal, remainder), the three adding up to x.

    The trend is the centred moving average over one period (over an even period the days at both ends count half), null near the
    ends of a series. The season of a phase is the mean of what the trend leaves there, or the median if ``robust``, less the mean
    of all phases. Phases count from 1970-01-01.
    """
    half = period // 2
    line = W.partitionBy("series").orderBy("day")
    around = line.rowsBetween(-half, half)
    if period % 2:
        mean = F.avg("x").over(around)
    else:
        mean = (F.avg("x").over(line.rowsBetween(-half, half - 1)) + F.avg("x").over(line.rowsBetween(1 - half, half))) / 2
    whole = F.count("x").over(around) == 2 * half + 1
    phase = F.pmod(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(period))
    rows = days.withColumns({"trend": F.when(whole, mean), "phase": phase})
    rest = F.col("x") - F.col("trend")
    seasons = rows.groupBy("series", "phase").agg((F.median(rest) if robust else F.avg(rest)).alias("raw"))
    seasons = seasons.select("series", "phase", (F.col("raw") - F.avg("raw").over(W.partitionBy("series"))).alias("seasonal"))
    return rows.join(seasons, ["series", "phase"]).select(
        "series", "day", "x", "trend", "seasonal", (rest - F.col("seasonal")).alias("remainder")
    )


def _holt(values: Column, alpha: Column, beta: Column, origins: int) -> Column:
    """Level, trend and the errors of the last forecasts, by the recursion over an array of at least two values."""
    n = F.size(values)
    first, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    zero = F.lit(0.0)
    start = F.struct(
        first.alias("level"), (second - first).alias("trend"), first.alias("last"), F.lit(1).alias("t"), zero.alias("off"), zero.alias("naive_off")
    )

    def step(s: Column, x: Column) -> Column:
        ahead = s["level"] + s["trend"]
        level = alpha * x + (1 - alpha) * ahead
        counts = s["t"] >= n - F.least(F.lit(origins), n - 1)
        return F.struct(
            level.alias("level"),
            (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"),
            x.alias("last"),
            (s["t"] + 1).alias("t"),
            (s["off"] + F.when(counts, F.abs(x - ahead)).otherwise(zero)).alias("off"),
            (s["naive_off"] + F.when(counts, F.abs(x - s["last"])).otherwise(zero)).alias("naive_off"),
        )

    return F.aggregate(F.slice(values, F.lit(2), n), start, step)


def forecast(days: DataFrame, steps: int, origins: int = 7, alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS) -> DataFrame:
    """(series, alpha, beta, mae, naive_mae, step, forecast): each series ``steps`` days ahead by exponential smoothing with trend.

    All pairs of parameters run over each series; the one with the smallest mean error of one-day forecasts from the last
    ``origins`` days is taken (to nine digits, then the smaller parameters). ``naive_mae`` is the error of repeating the last day.
    A series needs two days.
    """
    held = days.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("a"))
    held = held.where(F.size("a") >= 2).select("series", F.transform("a", lambda s: s["x"]).alias("v"))
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for a in alphas for b in betas])
    tried = held.select("series", "v", F.explode(grid).alias("g"))
    tried = tried.withColumn("s", _holt(F.col("v"), F.col("g.alpha"), F.col("g.beta"), origins))
    used = F.least(F.lit(origins), F.size("v") - 1)
    tried = tried.select("series", "g.*", "s.level", "s.trend", (F.col("s.off") / used).alias("mae"), (F.col("s.naive_off") / used).alias("naive_mae"))
    best = F.min_by(F.struct("alpha", "beta", "mae", "naive_mae", "level", "trend"), F.struct(F.round("mae", 9), "alpha", "beta"))
    ahead = tried.groupBy("series").agg(best.alias("b")).select("series", "b.*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return ahead.select(
        "series", "alpha", "beta", "mae", "naive_mae", "step", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast")
    )


# --- outliers ----------------------------------------------------------------


def zscore_outliers(df: DataFrame, key: str, columns: Sequence[str], group: str | None = None, limit: float = 3.0) -> DataFrame:
    """(key, group, column_name, value, z): values further than ``limit`` standard deviations from the mean of their column (and group).

    Means and deviations are merged as centred moments, so large means cost no digits. Missing values don't count, nor does a
    column without spread. Two scans.
    """
    by = F.col(group) if group else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), by.alias("grp"), *[known(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    moments = [(F.avg(f"x{i}").alias(f"m{i}"), F.stddev_samp(f"x{i}").alias(f"s{i}")) for i in range(len(columns))]
    known_of = rows.groupBy("grp").agg(*[m for pair in moments for m in pair]).withColumnRenamed("grp", "g")
    joined = rows.join(known_of, F.col("grp").eqNullSafe(F.col("g")))
    far = [
        F.when(F.col(f"s{i}") > 0, F.struct(F.lit(c).alias("column_name"), F.col(f"x{i}").alias("value"), ((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias("z")))
        for i, c in enumerate(columns)
    ]
    found = F.filter(F.array(*far), lambda c: F.abs(c["z"]) > limit)
    return joined.select("key", "grp", F.explode(found).alias("o")).select(F.col("key").alias(key), F.col("grp").alias("group"), "o.*")
