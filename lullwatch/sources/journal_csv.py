"""Journal and dictionary files: all-string CSV with fixed columns, typed afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullwatch.functions import text
from lullwatch.operators.tree import fix_roots

# ---- fixed values: column names of the customer's files ---------------------------------------------------------------
JOURNAL_COLUMNS = {"ид_события": "event_id", "ид_канала_данных": "channel_id", "дата": "date", "время": "time",
                   "тревожное": "alarm", "значение_датчика": "value"}
OBJECT_COLUMNS = {"ид_объект": "id", "иерархия_уровень": "level", "родитель": "parent_id", "вид_объекта": "kind",
                  "диспетчерское_название_объекта": "name"}
CHANNEL_COLUMNS = {"ид_канала_данных": "id", "ид_объект": "object_id", "тип_инж_системы": "system_type", "тип_датчика": "sensor_type",
                   "тег_инженерной_системы": "tag", "название_датчика": "name"}
STATE_COLUMNS = {"тип_датчика": "sensor_type", "ид_набор_состояний": "state_set", "название_состояния": "state", "тревожное": "alarm"}
# ------------------------------------------------------------------------------------------------------------------------


def read_journal_csv(spark: SparkSession, path: str) -> DataFrame:
    """The six journal columns as text; short rows are padded with NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in JOURNAL_COLUMNS])
    raw = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    return raw.withColumnsRenamed(JOURNAL_COLUMNS)


def _named(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    return raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in names.items()])


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    o = _named(spark, path, OBJECT_COLUMNS)
    return fix_roots(o.select(F.col("id").cast("long"), F.col("level").cast("int"), F.col("parent_id").try_cast("long").alias("parent_id"),
                              "kind", F.trim("name").alias("name")))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    c = _named(spark, path, CHANNEL_COLUMNS)
    c = c.select(F.col("id").cast("long"), F.col("object_id").cast("long"),
                 *[F.trim(n).alias(n) for n in ("system_type", "sensor_type", "tag", "name")])
    tag = F.col("tag")
    return c.withColumns({**{f"tag_l{n}": text.tag_level(tag, n) for n in range(1, 6)}, "tag_depth": text.tag_depth(tag),
                          **text.name_flags(F.col("name"))})


def read_states(spark: SparkSession, path: str) -> DataFrame:
    s = _named(spark, path, STATE_COLUMNS)
    return s.select(F.trim("sensor_type").alias("sensor_type"), F.col("state_set").cast("int"), F.trim("state").alias("state"),
                    F.lower("alarm").isin("t", "true").alias("is_alarm"))
