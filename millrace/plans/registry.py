"""Where modules of queries enter their DataFrames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.canonical import CANONICAL
from millrace.sources.scratch import reachable
from millrace.sources.testdata import STAGING, Staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str = "", name: str | None = None):
    """Registers f(staging) under its name. base: '' for plain SQL, 'staging' or 'canonical' for SQL over those tables."""

    def add(f: Callable[[Staging], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Staging(reachable(spark), sf_dir))
        if sql:
            ORACLES[key] = {"": "", "staging": STAGING, "canonical": STAGING + CANONICAL}[base] + sql
        return f

    return add
