"""Exports: XML journal, CSV of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_xml(df: DataFrame, path: str, root: str = "journal", row: str = "prediction", key: str = "id") -> None:
    """Records as XML; ``key`` becomes an attribute, moments are ISO text, empty fields are left out."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        cols.append(c.alias(f"_{f.name}" if f.name == key else f.name))
    df.select(*cols).write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def export_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    iso = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
           for f in df.schema.fields]
    df.select(*iso).write.mode("overwrite").csv(path, sep=sep, header=True, escape='"')
