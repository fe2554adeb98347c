"""Recency, frequency and monetary value per customer; scores and rule segments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exprs import as_timestamp, ratio
from tallyloom.functions.ranking import (
    global_rank,
    quintile_by_edges,
    quintile_by_rank,
    quintile_by_share,
    rows_below,
)
from tallyloom.session import materialise

# The four customer segments, best first.
VIP, LOYAL, POTENTIAL, AT_RISK = (
    "VIP Customers",
    "Loyal Customers",
    "Potential Customers",
    "At-Risk Customers",
)
SEGMENTS = [VIP, LOYAL, POTENTIAL, AT_RISK]

DAY_SECONDS = 86400


def _whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / DAY_SECONDS).cast("int")


def customer_activity(clean: DataFrame) -> DataFrame:
    """Per customer: last purchase, distinct invoices, spend, most frequent country.

    One scan feeds two grouping sets, (customer, invoice) and (customer, country).
    Both are combined before the shuffle, and a customer with a third of all rows is
    spread over its invoices, so no task sees its raw rows.
    """
    level = F.grouping_id()
    pieces = clean.groupingSets(
        [["customer", "invoice"], ["customer", "country"]], "customer", "invoice", "country"
    ).agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("rows"),
        F.max("date").alias("last"),
        F.sum("total_price").alias("spend"),
    )
    # grouping_id marks the columns left out: country -> 1, invoice -> 2.
    per_invoice, per_country = F.col("level") == 1, F.col("level") == 2
    most_rows = F.when(
        per_country & F.col("country").isNotNull(), F.struct(-F.col("rows"), F.col("country"))
    )
    return (
        pieces.where(F.col("customer").isNotNull())
        .groupBy("customer")
        .agg(
            F.max("last").alias("last_purchase"),
            F.count(F.when(per_invoice, F.col("invoice"))).alias("frequency"),
            F.sum(F.when(per_invoice, F.col("spend"))).alias("monetary"),
            F.min_by("country", most_rows).alias("country"),
        )
        .withColumnRenamed("customer", "customer_code")
    )


def rfm_base(clean: DataFrame, reference_date: date | None = None) -> DataFrame:
    """Customer activity with recency in whole days before the reference midnight.

    The reference defaults to the day after the last purchase. The customer-sized
    result is stored once: the reference, the ranks and the scores all read it.
    """
    activity = materialise(customer_activity(clean), "activity")
    if reference_date is None:
        latest = activity.agg(F.max("last_purchase").alias("latest")).scalar()
        reference = F.date_add(F.to_date(latest), 1).cast("timestamp")
    else:
        reference = F.lit(reference_date).cast("timestamp")
    return activity.withColumn("recency_days", _whole_days(reference, F.col("last_purchase")))


def rank_quintiles(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, <metric>_fifth ...): fifths of each metric, ties broken by the key.

    All metrics are ranked together in one range shuffle of (metric, value, key).
    """
    return _fifths(_ranked(df, key, metrics), key, metrics)


def _ranked(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, metric, value, rank, n) from one range shuffle of (metric, value, key)."""
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [key], list(metrics), "metric", "value"
    )
    return global_rank(long, "value", [key], ["metric"])


def _fifths(ranked: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    fifth = quintile_by_rank(F.col("rank"), F.col("n"))
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == m, fifth)).alias(f"{m}_fifth") for m in metrics]
    )


def _value_fifth(ranked: DataFrame, column: str) -> Column:
    """Fifth of the value itself, cut at the exact 20/40/60/80 % quantiles, which are read
    off the ranks.

    Repeated cut points are allowed; a value's fifth counts the cuts below it.
    """
    mine = ranked.where(F.col("metric") == column)
    cuts = []
    for share in (0.2, 0.4, 0.6, 0.8):
        at = (F.col("n") - 1) * F.lit(share)
        low = F.max(F.when(F.col("rank") - 1 == F.floor(at), F.col("value")))
        high = F.max(F.when(F.col("rank") - 1 == F.ceil(at), F.col("value")))
        cuts.append(low + (high - low) * F.max(at - F.floor(at)))
    return quintile_by_edges(F.col(column), mine.agg(F.array(*cuts)).scalar())


def value_quintile(df: DataFrame, column: str, key: str = "customer_code") -> Column:
    """The fifth of a column by its value, for a frame with a unique key."""
    return _value_fifth(_ranked(df, key, [column]), column)


def combined_score(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> Column:
    return F.col(r) * 100 + F.col(f) * 10 + F.col(m)


def rfm_scores(base: DataFrame) -> DataFrame:
    """Score an ``rfm_base`` table: recency by value, frequency and spend by rank."""
    ranked = _ranked(base, "customer_code", ["recency_days", "frequency", "monetary"])
    fifths = _fifths(ranked, "customer_code", ["frequency", "monetary"])
    scored = base.withColumn("r_score", 6 - _value_fifth(ranked, "recency_days")).join(fifths, "customer_code")
    return scored.withColumnsRenamed({"frequency_fifth": "f_score", "monetary_fifth": "m_score"}).withColumn(
        "rfm_score", combined_score()
    )


def rfm_generic(df: DataFrame, customer: str, when: str, amount: str) -> DataFrame:
    """RFM of any table: frequency counts rows, the reference is one day after the
    latest timestamp, and all three scores go by rank."""
    rows = df.select(
        F.col(customer).alias("customer_code"), as_timestamp(df, when).alias("at"), F.col(amount).alias("amount")
    ).dropna()
    activity = materialise(
        rows.groupBy("customer_code").agg(
            F.max("at").alias("last"), F.count("at").alias("frequency"), F.sum("amount").alias("monetary")
        ),
        "activity",
    )
    latest = activity.agg(F.max("last").alias("latest")).scalar()
    reference = latest + F.expr("INTERVAL 1 DAY")
    base = activity.withColumn("recency_days", _whole_days(reference, F.col("last"))).drop("last")
    fifths = rank_quintiles(base, "customer_code", ["recency_days", "frequency", "monetary"])
    scores = fifths.select(
        "customer_code",
        (6 - F.col("recency_days_fifth")).alias("r_score"),
        F.col("frequency_fifth").alias("f_score"),
        F.col("monetary_fifth").alias("m_score"),
    )
    return base.join(scores, "customer_code").withColumn("rfm_score", combined_score())


def rfm_asof(customers: DataFrame, orders: DataFrame, today: date) -> DataFrame:
    """RFM of registered customers as of a day; scores from the share of customers
    strictly below. Customers without orders are left out."""
    per_customer = orders.groupBy("customer_id").agg(
        F.max("order_date").alias("last"),
        F.countDistinct("invoice_id").alias("frequency"),
        F.sum("total_price").alias("monetary"),
    )
    base = materialise(
        customers.select("customer_id")
        .join(per_customer, "customer_id")
        .select(
            "customer_id",
            F.datediff(F.lit(today), F.col("last")).alias("recency_days"),
            "frequency",
            "monetary",
        ),
        "asof",
    )
    metrics = ["recency_days", "frequency", "monetary"]
    placed = rows_below(base, metrics)
    fifth = {m: quintile_by_share(F.col(f"{m}_below"), F.col("n")) for m in metrics}
    return placed.select(
        "customer_id",
        *metrics,
        (6 - fifth["recency_days"]).alias("r_score"),
        fifth["frequency"].alias("f_score"),
        fifth["monetary"].alias("m_score"),
    ).withColumn("rfm_score", combined_score())


def rule_segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (m >= 4), VIP)
        .when(f >= 4, LOYAL)
        .when((r >= 3) & (f <= 2), POTENTIAL)
        .otherwise(AT_RISK)
    )


def rfm_segments(scored: DataFrame) -> DataFrame:
    """Add the rule-based ``segment_label``."""
    return scored.withColumn(
        "segment_label", rule_segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    )


def score_distribution(scored: DataFrame) -> DataFrame:
    """(dimension, score, customers) for scores 1..5; monetary lists only scores in use."""
    spark = scored.sparkSession
    counts = (
        scored.select(
            F.explode(
                F.array(
                    F.struct(F.lit("recency").alias("dimension"), F.col("r_score").alias("score")),
                    F.struct(F.lit("frequency").alias("dimension"), F.col("f_score").alias("score")),
                    F.struct(F.lit("monetary").alias("dimension"), F.col("m_score").alias("score")),
                )
            ).alias("s")
        )
        .groupBy("s.dimension", "s.score")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    grid = spark.range(1, 6).select(
        F.explode(F.array(F.lit("recency"), F.lit("frequency"))).alias("dimension"),
        F.col("id").cast("int").alias("score"),
    )
    return (
        counts.join(grid, ["dimension", "score"], "full")
        .select("dimension", "score", F.coalesce("customers", F.lit(0)).alias("customers"))
    )


def segment_stats(segmented: DataFrame) -> DataFrame:
    """Per segment: customers, share of all, mean recency, frequency and spend.

    The total is taken over the finished segments, a handful of rows.
    """
    rows = F.count(F.lit(1))
    grouped = segmented.groupBy("segment_label").agg(
        rows.alias("customers"),
        (F.sum("recency_days") / rows).alias("avg_recency"),
        (F.sum("frequency") / rows).alias("avg_frequency"),
        (F.sum("monetary").cast("double") / rows).alias("avg_monetary"),
    )
    everyone = F.sum("customers").over(W.partitionBy())
    return grouped.select(
        "segment_label",
        "customers",
        ratio(F.col("customers") * 100, everyone).alias("share_pct"),
        "avg_recency",
        "avg_frequency",
        "avg_monetary",
    )
