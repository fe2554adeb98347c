"""Customer and entity directories: lookup, search, filter, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exprs import as_timestamp, ratio, total
from tallyloom.operators.rfm import AT_RISK, LOYAL, POTENTIAL, VIP

SORTABLE = [
    "total_revenue",
    "total_orders",
    "recency_days",
    "frequency",
    "monetary",
    "rfm_score",
    "name",
    "country",
]

# What to do for each segment.
PLAYBOOK = {
    VIP: [
        "Offer exclusive loyalty rewards",
        "Provide early access to new products",
        "Assign dedicated account manager",
    ],
    LOYAL: [
        "Cross-sell complementary products",
        "Upsell premium tiers",
        "Send personalised thank-you offers",
    ],
    POTENTIAL: [
        "Send promotional offers",
        "Encourage product discovery",
        "Offer first-time repeat-purchase discount",
    ],
    AT_RISK: [
        "Launch win-back email campaign",
        "Offer special retention discount",
        "Schedule proactive outreach",
    ],
}
DEFAULT_PLAY = ["Review purchase history", "Engage with personalised communication"]


def segment_actions(label: Column) -> Column:
    """Recommended actions for a segment label, as an array."""
    pairs = []
    for segment, plays in PLAYBOOK.items():
        pairs += [F.lit(segment), F.array(*[F.lit(p) for p in plays])]
    other = F.array(*[F.lit(p) for p in DEFAULT_PLAY])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(label, F.lit(""))), other)


def customer_directory(
    customers: DataFrame, orders: DataFrame, rfm: DataFrame, segments: DataFrame
) -> DataFrame:
    """Every customer with order totals, RFM values and segment.

    Orders are reduced to one row per customer before the joins, and rfm/segments
    have one row per customer, so the three left joins on the same key never fan
    out and can share one partitioning.
    """
    totals = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("total_price").alias("revenue"),
        F.max("order_date").alias("last_purchase_date"),
    )
    scores = rfm.select(
        "customer_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score"
    )
    return (
        customers.join(totals, "customer_id", "left")
        .join(scores, "customer_id", "left")
        .join(segments.select("customer_id", "segment_label"), "customer_id", "left")
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
        .withColumn("total_revenue", F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)))
        .drop("revenue")
    )


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the term, ignoring case."""
    needle = term.lower()
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.lower(F.col(column).cast("string")).contains(needle)
    return df.where(hit)


def filter_directory(
    directory: DataFrame, term: str | None = None, segment: str | None = None, country: str | None = None
) -> DataFrame:
    if term:
        directory = search(directory, term, ["name", "customer_code"])
    if segment:
        directory = directory.where(F.col("segment_label") == segment)
    if country:
        directory = search(directory, country, ["country"])
    return directory


def sort_page(
    directory: DataFrame,
    key: str,
    sort_by: str = "total_revenue",
    descending: bool = True,
    page: int = 1,
    page_size: int = 25,
) -> DataFrame:
    """One page, sorted by an allowed column; ties by the key."""
    column = F.col(sort_by if sort_by in SORTABLE else "total_revenue")
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return directory.orderBy(order, key).offset((page - 1) * page_size).limit(page_size)


def key_page(df: DataFrame, key: str, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page in key order."""
    return df.orderBy(key).offset((page - 1) * page_size).limit(page_size)


def page_counts(df: DataFrame, page_size: int = 25) -> DataFrame:
    """Row and page totals of a filtered directory."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("total"),
        F.greatest(F.ceil(rows / page_size), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def customer_detail(
    customer_id, customers: DataFrame, orders: DataFrame, rfm: DataFrame, segments: DataFrame, recent: int = 50
) -> DataFrame:
    """One customer's directory row, order value, actions and newest orders.

    The key is filtered on all four inputs before they meet.
    """
    one = [df.where(F.col("customer_id") == F.lit(customer_id)) for df in (customers, orders, rfm, segments)]
    latest = (
        recent_orders(one[1], recent)
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct("recent_rank", "invoice_id", "order_date", "total_price"))).alias("orders"))
    )
    return (
        customer_directory(*one)
        .join(latest, "customer_id", "left")
        .withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("total_orders")))
        .withColumn("recommended_actions", segment_actions(F.col("segment_label")))
    )


def recent_orders(orders: DataFrame, k: int = 50) -> DataFrame:
    """The newest k order lines of every customer. Rows past k are dropped before
    the shuffle (window group limit), so a hot customer stays small."""
    newest = W.partitionBy("customer_id").orderBy(F.desc("order_date"), "invoice_id", "line_id")
    return orders.withColumn("recent_rank", F.row_number().over(newest)).where(F.col("recent_rank") <= k)


def latest_per_group(df: DataFrame, group: str, active: str, when: str, key: str) -> DataFrame:
    """Per group the active row if there is one, else the newest; ties by key.

    An aggregate rather than a sort: groups of any size are combined map-side.
    """
    order = F.struct(F.col(active).cast("int"), F.col(when), F.col(key))
    row = F.struct(*[F.col(c) for c in df.columns if c != group])
    return df.groupBy(group).agg(F.max_by(row, order).alias("latest")).select(group, "latest.*")


def entity_directory(df: DataFrame, entity: str, row_key: str, amount: str | None, place: str | None) -> DataFrame:
    """Rows, summed amount and first known place per entity."""
    first_place = (
        F.min_by(F.col(place), F.when(F.col(place).isNotNull(), F.col(row_key)))
        if place
        else F.lit("Global")
    )
    return (
        df.where(F.col(entity).isNotNull())
        .groupBy(F.col(entity).cast("string").alias("customer_code"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            (total(F.col(amount)) if amount else F.lit(0.0)).alias("total_revenue"),
            first_place.alias("country"),
        )
    )


def _is_value(df: DataFrame, column: str, value: str) -> Column:
    """The column's text equals the value. The value is brought to the column's type, so
    that the scan can skip by it; a value that reads otherwise in that type fits nothing."""
    text = F.lit(str(value))
    typed = text.try_cast(df.schema[column].dataType)
    return (F.col(column) == typed) & (typed.cast("string") == text)


def entity_summary(
    df: DataFrame,
    entity: str,
    value: str,
    row_key: str,
    amount: str | None = None,
    place: str | None = None,
    when: str | None = None,
    attributes: int = 12,
) -> DataFrame:
    """Totals, first place, last activity and the first row's attributes of one entity."""
    rows = df.where(_is_value(df, entity, value))
    pairs = []
    for name in df.columns[:attributes]:
        pairs += [F.lit(name), F.col(name).cast("string")]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    sums = rows.agg(
        F.count(F.lit(1)).alias("total_orders"),
        (total(F.col(amount)) if amount else F.lit(0.0)).alias("total_revenue"),
        (
            F.coalesce(F.min_by(F.col(place).cast("string"), F.col(row_key)), F.lit("Global"))
            if place
            else F.lit("Global")
        ).alias("country"),
        (F.max(as_timestamp(df, when)) if when else F.lit(None).cast("timestamp")).alias("last_activity"),
        F.min_by(known, row_key).alias("attributes"),
    )
    return sums.where(F.col("total_orders") > 0).withColumn("customer_code", F.lit(str(value)))


def entity_records(df: DataFrame, entity: str, value: str, row_key: str, k: int = 10) -> DataFrame:
    """The entity's first k rows in key order."""
    return df.where(_is_value(df, entity, value)).orderBy(row_key).limit(k)
