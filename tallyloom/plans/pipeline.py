"""The whole transaction run: validate, clean, score, cluster, hand over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallyloom.functions.columns import missing_fields
from tallyloom.operators.cleaning import clean_stats, clean_transactions, orders_table
from tallyloom.operators.clustering import Clustering, customer_segments
from tallyloom.operators.rfm import rfm_base, rfm_scores


@dataclass
class PipelineResult:
    success: bool
    errors: list[str] = field(default_factory=list)
    rfm: DataFrame | None = None
    orders: DataFrame | None = None
    customer_country: DataFrame | None = None
    clean_stats: DataFrame | None = None
    clustering: Clustering | None = None


def run_pipeline(
    raw: DataFrame, row_key: str | None = None, n_clusters: int | None = None, restarts: int = 10
) -> PipelineResult:
    """Raw log in; scored and segmented customers, clean orders and statistics out."""
    problems = missing_fields(raw.columns)
    if problems:
        return PipelineResult(False, problems)
    clean = clean_transactions(raw, row_key)
    scored = rfm_base(clean)
    if scored.limit(1).count() == 0:
        return PipelineResult(False, ["No valid rows after cleaning"])
    segmented, result = customer_segments(rfm_scores(scored), n_clusters, restarts)
    return PipelineResult(
        True,
        rfm=segmented,
        orders=orders_table(clean),
        customer_country=segmented.select("customer_code", "country"),
        clean_stats=clean_stats(raw, row_key),
        clustering=result,
    )
