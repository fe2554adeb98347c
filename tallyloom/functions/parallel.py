"""Independent Spark jobs side by side, as model tuning does."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

R = TypeVar("R")
WIDTH = 4


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], R]], width: int = WIDTH) -> list[R]:
    """Results in the order of the jobs. Small fits leave most of a cluster idle when
    run one after the other."""
    if not jobs:
        return []
    with ThreadPoolExecutor(max_workers=min(width, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
