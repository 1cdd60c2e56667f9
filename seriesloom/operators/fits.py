"""Independent model fits from driver threads: while one fit has few tasks left, others use the cluster's cores."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A = TypeVar("A")
AT_ONCE = 8


def together(spark: SparkSession, jobs: list[Callable[[], A]], at_once: int = AT_ONCE) -> list[A]:
    """Results of `jobs` in their order, `at_once` of them running at a time; none for no jobs.

    Threads take over the caller's local properties (job group, scheduler pool), so one cancelled group ends all of
    them.  If a job fails, those not yet begun are dropped and its error is raised when the running ones have ended.
    """
    if not jobs:
        return []
    with ThreadPoolExecutor(min(at_once, len(jobs))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        try:
            return [f.result() for f in futures]
        except BaseException:
            for f in futures:
                f.cancel()
            raise
