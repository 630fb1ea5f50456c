"""Merging rows into Parquet tables that are partitioned by day: only the days that rows fall on are read and written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullwatch.session import write_stage


def ensure_table(spark: SparkSession, path: str, schema: T.StructType | str, partition: str | None = None) -> None:
    """Create an empty Parquet table, or leave the existing one as it is."""
    writer = spark.createDataFrame([], schema).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def days_of(rows: DataFrame, day: str = "day") -> list[date]:
    """The days of the rows: at most one value per calendar day."""
    return sorted(r[0] for r in rows.select(day).distinct().collect() if r[0] is not None)


def read_days(spark: SparkSession, path: str, schema: T.StructType | str, days: Sequence[date], day: str = "day") -> DataFrame:
    """The table's rows of some days; other partitions are not read."""
    return spark.read.schema(schema).parquet(path).filter(F.col(day).isin(list(days)))


def replace_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Overwrite the days that occur in ``rows``, which may have been read from the same table: they are written aside first."""
    kept = write_stage(rows, f"replace-{uuid.uuid4().hex}")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert(rows: DataFrame, path: str, key: Sequence[str], update: Sequence[str] | None = None, order: Sequence[str] = (), day: str = "day") -> dict[str, int]:
    """Insert rows whose key is new; of known keys overwrite the columns ``update``, or leave them as they are without it.

    ``key`` must determine the day; rows with a NULL in it are left out. Of rows with the same key the last by ``order`` counts when updating, the first
    when inserting only. ``order`` columns that the table holds also guard it: a row that is older than the stored one changes nothing, so a
    repeated or delayed batch is safe. Returns the numbers of inserted, updated and unchanged keys.
    """
    spark, key, order = rows.sparkSession, list(key), list(order)
    rest = [c for c in rows.columns if c not in key]
    pick = (F.max_by if update else F.min_by)(F.struct(*rest), F.struct(*(order or rest)))
    single = write_stage(rows.dropna(subset=[*key, day]).groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*").select(*rows.columns), f"upsert-{uuid.uuid4().hex}")
    days = days_of(single, day)
    if not days:
        return {"inserted": 0, "updated": 0, "unchanged": 0}
    old = read_days(spark, path, rows.schema, days, day)
    if not update:
        fresh = write_stage(single.join(old.select(*key), key, "left_anti"), f"upsert-{uuid.uuid4().hex}")
        inserted, total = fresh.count(), single.count()
        fresh.write.mode("append").partitionBy(day).parquet(path)
        return {"inserted": inserted, "updated": 0, "unchanged": total - inserted}
    both = old.select(*key, F.struct(*rest).alias("_old")).join(single.select(*key, F.struct(*rest).alias("_new")), key, "full")
    given, stored = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    guard = F.struct(*[F.col(f"_new.{c}") for c in order]) >= F.struct(*[F.col(f"_old.{c}") for c in order]) if order else F.lit(True)
    taken = given & stored & F.coalesce(guard, F.lit(True))
    changed = F.when(given & ~stored, "inserted").when(taken, "updated").when(given, "unchanged")
    value = lambda c: F.when(~stored | (taken if c in (*update, *order) else F.lit(False)), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    merged = write_stage(both.select(*key, *[value(c).alias(c) for c in rest], changed.alias("_changed")), f"upsert-{uuid.uuid4().hex}")
    counts = {r[0]: r[1] for r in merged.filter("_changed is not null").groupBy("_changed").count().collect()}
    merged.select(*rows.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return {k: counts.get(k, 0) for k in ("inserted", "updated", "unchanged")}


def upsert_dimension(rows: DataFrame, old: DataFrame, key: Sequence[str], update: Sequence[str]) -> DataFrame:
    """A dictionary table after an import: known keys take the columns ``update``, new ones are added; the last of repeated rows counts.

    Dictionaries are not partitioned by day and are written whole by the caller. ``rows`` may carry a ``row`` number that says which is last.
    """
    key = list(key)
    rank = Window.partitionBy(*key).orderBy(F.desc("row") if "row" in rows.columns else F.lit(0))
    new = rows.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").select(*old.columns).withColumn("_new", F.lit(True))
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_stored")).join(new, key, "full")
    takes = lambda c: F.col("_new") & F.lit(c in update) | F.col("_stored").isNull()
    return both.select(*key, *[F.when(F.coalesce(takes(c), F.lit(False)), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in rest])
