"""Period slices of the serving tables with a manifest of row counts and checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_tables(tables: dict[str, tuple[DataFrame, str | None, int]], date_from: str, date_to: str) -> dict[str, DataFrame]:
    """``name -> (table, time column or None, days of history before the period)``; a table without time goes whole."""
    out = {}
    for name, (df, ts, back) in tables.items():
        if ts is not None:
            lo = F.date_sub(F.lit(date_from).cast("date"), back).cast("timestamp")
            hi = F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp")
            df = df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))
        out[name] = df
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: columns, row count and an order-free checksum."""
    rows = [df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum")).select(
        F.lit(name).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"), "rows", "checksum") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def export_slice(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest(tables).write.mode("overwrite").json(f"{path}/manifest")


def validate_slice(expected: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Differences between a manifest and the tables: missing or extra table, columns, rows, checksum. Empty when all match."""
    have = manifest(tables).withColumnsRenamed({"columns": "h_columns", "rows": "h_rows", "checksum": "h_checksum"})
    j = expected.join(have, "table_name", "full_outer")
    problem = (
        F.when(F.col("h_rows").isNull(), "table is missing").when(F.col("rows").isNull(), "table is not expected")
        .when(F.col("columns") != F.col("h_columns"), "columns differ").when(F.col("rows") != F.col("h_rows"), "row count differs")
        .when(F.col("checksum") != F.col("h_checksum"), "checksum differs")
    )
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("table_name", "problem")
