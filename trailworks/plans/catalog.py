"""Query catalog: each entry is a Spark job over the driver tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under a name."""
    def add(fn: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"duplicate query {name}")
        JOBS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load() -> None:
    from . import (queries_business, queries_logs, queries_retrieval, queries_store,  # noqa: F401
                   queries_text, queries_trajectory, queries_trials)
