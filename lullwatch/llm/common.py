"""Query registry, written stages and small Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZE_BYTES = 6 << 20
"""Uncompressed bytes a Python task gathers before it hands them on."""


def register(name: str, oracle: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``; a temporary one only under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="lullwatch-llm-")
    return _own


_own: str | None = None


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later jobs neither repeat its work nor depend on one executor."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand freed memory to the operating system: Spark keeps Python workers for later tasks, and with them what they have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty_map(task):
    """``task`` for mapInArrow, freed memory given back when its partition ends."""
    def run(batches):
        yield from task(batches)
        give_back()
    return run


def thrifty_group(task):
    """``task`` for applyInArrow on groups, freed memory given back after each group."""
    def run(rows):
        out = task(rows)
        give_back()
        return out
    return run


def thrifty_cogroup(task):
    """``task`` for applyInArrow on co-groups, freed memory given back after each."""
    def run(left, right):
        out = task(left, right)
        give_back()
        return out
    return run
