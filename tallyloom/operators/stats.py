"""Correlations, hypothesis tests and feature-target relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.brackets import quantiles_of
from tallyloom.functions.columns import is_numeric, numeric_columns, text_columns
from tallyloom.functions.exprs import is_missing, known, literal
from tallyloom.functions.ranking import global_rank, running_counts, value_counts
from tallyloom.functions.tails import chi2_pvalue, f_pvalue, t_pvalue
from tallyloom.operators import gram
from tallyloom.session import materialise

ALPHA = 0.05
LEAST_GROUP = 5


# --- correlations ----------------------------------------------------------


def rank_vectors(df: DataFrame) -> DataFrame:
    """``v`` (array of double) with every entry replaced by its 1-based rank at that place, ties sharing the mean rank.

    Rows with a null or NaN go. All places are ranked in one table and looked up in one join by (place, value); the ranks of a
    row come back together by one grouping.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    stored = materialise(df.where(whole).select(F.monotonically_increasing_id().alias("row"), "v"), "rank-rows")
    long = stored.select("row", F.posexplode("v").alias("place", "value"))
    ranks = running_counts(value_counts(long, ["place"], "value"), ["place"], "value")
    ranks = ranks.select("place", "value", (F.col("below") + (F.col("rows") + 1) / 2).alias("rank"))
    ranked = long.join(ranks, ["place", "value"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "rank"))).alias("r"))
    return ranked.select(F.transform("r", lambda x: x["rank"]).alias("v"))


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>").alias("v"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(var1, var2, i, j, correlation, rows) for each pair i < j of numeric columns,
    over rows without nulls or NaN; null if either is constant. One scan, however many columns there are."""
    columns = list(columns or numeric_columns(df))
    rows = _vectors(df, columns)
    found = gram.correlations(rank_vectors(rows) if method == "spearman" else rows, len(columns))
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(
        F.get(names, F.col("i")).alias("var1"), F.get(names, F.col("j")).alias("var2"), "i", "j", "correlation", "rows"
    )


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal: (var1, var2, correlation)."""
    upper = pairs.select("var1", "var2", "correlation")
    lower = pairs.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "correlation")
    names = pairs.select(F.explode(F.array("var1", "var2")).alias("var1")).distinct()
    diagonal = names.select("var1", F.col("var1").alias("var2"), F.lit(1.0).alias("correlation"))
    return upper.unionByName(lower).unionByName(diagonal)


def relationship(r: Column) -> Column:
    return (
        F.when(r > 0.7, "Strong Positive")
        .when(r > 0.3, "Moderate Positive")
        .when(r < -0.7, "Strong Negative")
        .when(r < -0.3, "Moderate Negative")
        .otherwise("Weak / None")
    )


def top_correlations(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The strongest pairs with a label; equal strengths in column order."""
    return (
        pairs.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .withColumn("abs_correlation", F.abs("correlation"))
        .orderBy(F.desc("abs_correlation"), "i", "j")
        .limit(k)
        .select("var1", "var2", "correlation", "abs_correlation", relationship(F.col("correlation")).alias("relationship"))
    )


def key_correlation(pairs: DataFrame, least: float = 0.65, rows: int = 15) -> DataFrame:
    """The strongest pair, if it is strong enough on enough rows."""
    return (
        pairs.where((F.abs("correlation") > least) & (F.col("rows") >= rows))
        .orderBy(F.desc(F.abs("correlation")), "i", "j")
        .limit(1)
        .select("var1", "var2", "correlation", "rows")
    )


# --- hypothesis tests ------------------------------------------------------


def _groups(df: DataFrame, category: str, measure: str, most: int) -> DataFrame:
    """Count, mean and variance per category value. One row more than ``most`` is
    kept, enough to see that there are too many."""
    value = known(F.col(measure).cast("double"))
    groups = (
        df.where(F.col(category).isNotNull())
        .groupBy(F.col(category).cast("string").alias("label"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
        .orderBy("label")
        .limit(most + 1)
    )
    return groups.agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "var"))).alias("g"))


def welch_ttest(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Welch's t-test of a measure between the two values of a category, smaller value
    first. No row unless there are two values with five measurements each; a null
    statistic where neither group varies."""
    a, b = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    groups = _groups(df, category, measure, 2).where(F.size("g") == 2)
    parts = groups.select(a.alias("a"), b.alias("b")).where(
        (F.col("a.n") >= LEAST_GROUP) & (F.col("b.n") >= LEAST_GROUP)
    )
    se_a, se_b = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    tested = parts.select(
        F.col("a.label").alias("group1"),
        F.col("b.label").alias("group2"),
        F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(se_a + se_b)).alias("statistic"),
        F.try_divide(
            (se_a + se_b) * (se_a + se_b), se_a * se_a / (F.col("a.n") - 1) + se_b * se_b / (F.col("b.n") - 1)
        ).alias("dof"),
    )
    return tested.withColumn("p_value", t_pvalue("statistic", "dof"))


def anova_oneway(df: DataFrame, category: str, measure: str) -> DataFrame:
    """One-way ANOVA over a category of 3 to 6 values, using groups of five or more
    measurements. No row unless three groups remain."""
    zero = F.lit(0.0)
    groups = _groups(df, category, measure, 6).where(F.size("g").between(3, 6))
    kept = groups.select(F.filter("g", lambda x: x["n"] >= LEAST_GROUP).alias("g")).where(F.size("g") >= 3)
    sums = kept.select(
        "g",
        F.size("g").alias("k"),
        F.aggregate("g", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n"),
        F.aggregate("g", zero, lambda s, x: s + x["n"] * x["mean"]).alias("total"),
    ).withColumn("grand", F.col("total") / F.col("n"))
    between = F.aggregate(
        "g", zero, lambda s, x: s + x["n"] * (x["mean"] - F.col("grand")) * (x["mean"] - F.col("grand"))
    )
    within = F.aggregate("g", zero, lambda s, x: s + (x["n"] - 1) * x["var"])
    tested = sums.select(
        F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("statistic"),
        (F.col("k") - 1).cast("bigint").alias("dof1"),
        (F.col("n") - F.col("k")).alias("dof2"),
    )
    return tested.withColumn("p_value", f_pvalue("statistic", "dof1", "dof2"))


def chi_square(df: DataFrame, first: str, second: str, most: int = 10) -> DataFrame:
    """Chi-squared test of independence of two categories of at most ten values, with
    Yates' correction on 2 x 2 tables. No row unless 80 % of the observed cells hold
    five or more."""
    cells = (
        df.select(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
        .dropna()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .limit(most * most + 1)
    )
    # At most 101 cells are listed; more than 100 means a category has too many values.
    listed = cells.agg(F.collect_list(F.struct("a", "b", "n")).alias("cells")).where(
        F.size("cells").between(1, most * most)
    )

    def count_where(test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(test(c), c["n"]).otherwise(0))

    sides = listed.select(
        "cells",
        F.array_distinct(F.transform("cells", lambda c: c["a"])).alias("rows"),
        F.array_distinct(F.transform("cells", lambda c: c["b"])).alias("columns"),
        F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c["n"]).alias("total"),
    ).where((F.size("rows") <= most) & (F.size("columns") <= most))
    grid = sides.select(
        "total",
        ((F.size("rows") - 1) * (F.size("columns") - 1)).alias("dof"),
        F.flatten(
            F.transform(
                "rows",
                lambda r: F.transform(
                    "columns",
                    lambda c: F.struct(
                        count_where(lambda x: (x["a"] == r) & (x["b"] == c)).cast("double").alias("seen"),
                        (count_where(lambda x: x["a"] == r) * count_where(lambda x: x["b"] == c)).cast("double").alias("product"),
                    ),
                ),
            )
        ).alias("grid"),
    )
    filled = F.size(F.filter("grid", lambda x: x["seen"] >= LEAST_GROUP)) / F.size("grid")
    gap = F.transform(
        "grid", lambda x: F.struct(F.abs(x["seen"] - x["product"] / F.col("total")).alias("d"), (x["product"] / F.col("total")).alias("e"))
    )

    def corrected(d: Column) -> Column:
        return F.when(F.col("dof") == 1, d - F.least(F.lit(0.5), d)).otherwise(d)

    statistic = F.aggregate(gap, F.lit(0.0), lambda s, x: s + corrected(x["d"]) * corrected(x["d"]) / x["e"])
    tested = grid.where(filled >= 0.8).select(statistic.alias("statistic"), F.col("dof").cast("bigint").alias("dof"))
    return tested.withColumn(
        "p_value", F.when(F.col("dof") > 0, chi2_pvalue("statistic", "dof")).otherwise(F.lit(1.0))
    )


def _told(
    test: DataFrame, name: str, variables: Column, yes: Column, no: Column, assumptions: str
) -> DataFrame:
    significant = F.col("p_value") < ALPHA
    return test.select(
        F.lit(name).alias("test_name"),
        variables.alias("variables"),
        "statistic",
        "p_value",
        significant.alias("is_significant"),
        F.when(significant, yes).otherwise(no).alias("interpretation"),
        F.lit(assumptions).alias("assumptions"),
    )


def statistical_tests(df: DataFrame, distinct: dict[str, int]) -> DataFrame | None:
    """All tests the table's columns allow, with their reading in words.

    ``distinct`` gives the distinct count of each category, as the profile has it.
    """
    measures, categories = numeric_columns(df), text_columns(df)
    parts = []
    two = next((c for c in categories if distinct[c] == 2), None)
    few = next((c for c in categories if 3 <= distinct[c] <= 6), None)
    if two and measures:
        m = measures[0]
        said, split = literal(m), literal(two)
        parts.append(
            _told(
                welch_ttest(df, two, m),
                "Two-Sample Welch's T-Test",
                F.format_string(f"{said} across {split} ('%s' vs '%s')", "group1", "group2"),
                F.format_string(
                    f"Statistically significant difference detected in {said} between %s and %s (p < 0.05).", "group1", "group2"
                ),
                F.format_string(
                    f"No statistically significant difference in {said} detected between %s and %s (p >= 0.05).",
                    "group1",
                    "group2",
                ),
                "Assumes continuous distribution; Welch's variant robust to unequal variances.",
            )
        )
    if few and measures:
        m = measures[0]
        parts.append(
            _told(
                anova_oneway(df, few, m),
                "One-Way ANOVA (Analysis of Variance)",
                F.lit(f"{m} grouped by {few}"),
                F.format_string(
                    f"Mean {literal(m)} varies significantly across groups of {literal(few)} (F = %.2f, p < 0.05).",
                    "statistic",
                ),
                F.lit(f"No significant difference in group means of {m} across {few}."),
                "Assumes normality and independent observations.",
            )
        )
    if len(categories) >= 2:
        a, b = categories[:2]
        parts.append(
            _told(
                chi_square(df, a, b),
                "Chi-Square Test of Independence",
                F.lit(f"{a} and {b}"),
                F.format_string(
                    f"Significant association detected between {literal(a)} and {literal(b)} (Chi2 = %.2f, p < 0.05).", "statistic"
                ),
                F.lit(f"{a} and {b} appear statistically independent."),
                "Expected frequencies in at least 80% of contingency table cells >= 5.",
            )
        )
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    return found


# --- features and targets --------------------------------------------------


def factorize(df: DataFrame, column: str, row_key: str) -> DataFrame:
    """(column, code): values numbered from 0 in order of first appearance by key."""
    firsts = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_key).alias("first_key"))
    )
    ranked = global_rank(firsts, "first_key", [column])
    return ranked.select(column, (F.col("rank") - 1).alias("code"))


def with_codes(df: DataFrame, column: str, row_key: str) -> DataFrame:
    """Replace a category by its code; null becomes -1."""
    codes = factorize(df, column, row_key).withColumnRenamed(column, "_value")
    joined = df.join(codes, df[column] == F.col("_value"), "left").drop("_value")
    return joined.withColumn(column, F.coalesce("code", F.lit(-1)).cast("double")).drop("code")


def feature_target_corr(df: DataFrame, target: str, features: Sequence[str], row_key: str) -> DataFrame:
    """(feature, correlation): Pearson with the target, categories by their codes,
    undefined values 0. One scan covers all features."""
    coded = df.where(~is_missing(df, target))
    for name in [target, *features]:
        if not is_numeric(df.schema[name].dataType):
            coded = with_codes(coded, name, row_key)
    rows = gram.against_first(_vectors(coded, [target, *features]), len(features) + 1)
    names = F.array(*[F.lit(f) for f in features])
    return rows.select(
        F.get(names, F.col("i") - 1).alias("feature"), F.coalesce(F.nanvl("correlation", F.lit(0.0)), F.lit(0.0)).alias("correlation")
    )


def binned_relationship(df: DataFrame, feature: str, target: str, max_bins: int = 6) -> DataFrame:
    """Mean feature and mean target in quantile bins of the feature. Equal edges are
    merged; bins are closed on the right."""
    rows = df.select(
        F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y")
    ).dropna()
    bins = rows.select("x").distinct().limit(max_bins).count()
    cuts = quantiles_of(rows, ["x"], [i / bins for i in range(bins + 1)] if bins else [0.0])
    edges = cuts.agg(F.array_sort(F.collect_set("quantile")).alias("edges")).scalar()
    bin_number = F.lit(0)
    for i in range(1, max_bins):  # the last edge closes the last bin
        inner = (F.size(edges) > i + 1) & (F.col("x") > F.get(edges, F.lit(i)))
        bin_number = bin_number + F.coalesce(inner, F.lit(False)).cast("int")
    binned = rows.withColumn("bin", bin_number)
    return (
        binned.groupBy("bin")
        .agg(F.avg("x").alias("feature_avg"), F.avg("y").alias("target_avg"), F.count(F.lit(1)).alias("rows"))
        .withColumns({"low": F.get(edges, F.col("bin")), "high": F.get(edges, F.col("bin") + 1)})
    )
