"""Named checks: a Spark program over the test bed and, where SQL can say it, the DuckDB text with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.testbed.adapter import Bed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Bed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Bed(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def secs(col: str, alias: str | None = None):
    """Timestamps leave a check as epoch seconds: the two engines print them differently."""
    return F.unix_timestamp(col).alias(alias or col)
