"""Session settings and the shared folder for written stages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lullwatch", master: str | None = None, cores: int = 8) -> SparkSession:
    """Session for tests and the benchmark; on a cluster pass the session that spark-submit gives."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a single-JVM master without that setting (tests) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder shared by all executors")
    global _fallback
    _fallback = _fallback or tempfile.mkdtemp(prefix="lullwatch-")
    return _fallback


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet into the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "stages", spark.sparkContext.applicationId, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
