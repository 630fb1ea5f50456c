"""Object tree: closure over all levels, subtree and scope filters, roll-ups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullwatch.session import write_stage


def closure(objects: DataFrame) -> DataFrame:
    """``(ancestor_id, id, distance)`` including the object itself, by doubling: a written table of jumps for every power of two up to the depth.

    A jump table of 2n steps is the one of n steps joined with itself, so a tree of any depth takes as many jobs as its depth has binary digits, and no level is computed
    twice. The closure itself is lazy: from the longest jumps to the shortest, each row goes on both with and without one. Parents that form a cycle are an error.
    """
    jumps = [objects.filter(F.col("parent_id") != F.col("id")).select(F.col("id").alias("_from"), F.col("parent_id").alias("_to"))]
    limit = None
    while True:
        last = jumps[-1]
        longer = write_stage(last.join(last.select(F.col("_from").alias("_to"), F.col("_to").alias("_far")), "_to").select("_from", F.col("_far").alias("_to")), f"jumps-{uuid.uuid4().hex}")
        if longer.isEmpty():
            break
        jumps.append(longer)
        limit = limit or objects.count()
        if 1 << len(jumps) - 1 > limit:
            raise ValueError("parents of objects form a cycle")
    out = objects.select(F.col("id").alias("ancestor_id"), F.col("id"), F.lit(0).alias("distance"))
    for k in reversed(range(len(jumps))):
        further = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("ancestor_id"), (F.col("distance") + (1 << k)).alias("distance")))
        both = F.array_compact(F.array(F.struct("ancestor_id", "distance"), further))
        out = out.join(jumps[k], F.col("ancestor_id") == F.col("_from"), "left").select("id", F.inline(both)).select("ancestor_id", "id", "distance")
    return out


def fix_roots(objects: DataFrame) -> DataFrame:
    """A parent that is not in the table makes the object a root."""
    known = objects.select(F.col("id").alias("_known"))
    return objects.join(known, F.col("parent_id") == F.col("_known"), "left").withColumn(
        "parent_id", F.col("_known")).drop("_known").select(*objects.columns)


def paths(objects: DataFrame, sep: str = " → ") -> DataFrame:
    """``(id, path)`` from the root down."""
    names = objects.select(F.col("id").alias("ancestor_id"), "name")
    up = closure(objects).join(names, "ancestor_id")
    chain = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return up.groupBy("id").agg(F.array_join(F.transform(chain, lambda s: s["name"]), sep).alias("path"))


def subtree_ids(objects: DataFrame, roots: Sequence[int]) -> DataFrame:
    return closure(objects).filter(F.col("ancestor_id").isin(list(roots))).select("id").distinct()


def scope_objects(objects: DataFrame, roots: Sequence[int]) -> DataFrame:
    """Visible objects of a scope: subtrees of its roots (``own``) and their ancestors as folders."""
    links = closure(objects)
    own = links.filter(F.col("ancestor_id").isin(list(roots))).select("id").distinct()
    folders = links.join(own, "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
    return (
        objects.join(folders, "id", "left_semi")
        .join(own.withColumn("own", F.lit(True)), "id", "left")
        .withColumn("own", F.coalesce("own", F.lit(False)))
    )


def scope_filter(df: DataFrame, objects: DataFrame, roots: Sequence[int], object_col: str = "object_id") -> DataFrame:
    """Rows whose object lies in the scope."""
    own = subtree_ids(objects, roots).withColumnRenamed("id", object_col)
    return df.join(own, object_col, "left_semi")


def filter_channels(
    channels: DataFrame, objects: DataFrame, object_id: int | None = None, system_type: str | None = None,
    sensor_type: str | None = None, q: str | None = None,
) -> DataFrame:
    """Channels of a subtree, system, type, and a case-insensitive search in name, tag or exact id."""
    out = channels
    if object_id is not None:
        out = scope_filter(out, objects, [object_id])
    if system_type:
        out = out.filter(F.col("system_type") == system_type)
    if sensor_type:
        out = out.filter(F.col("sensor_type") == sensor_type)
    if q:
        text = q.strip()
        found = F.col("name").ilike(f"%{text}%") | F.col("tag").ilike(f"%{text}%")
        if text.isdigit():
            found = found | (F.col("id") == int(text))
        out = out.filter(found)
    return out


def tree_rollup(direct: DataFrame, objects: DataFrame, key: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregate ``direct`` (rows per own object) over every ancestor; objects without rows are kept."""
    up = closure(objects).select("ancestor_id", F.col("id").alias(key))
    rolled = direct.join(up, key).groupBy("ancestor_id").agg(*aggs)
    return objects.join(rolled, objects["id"] == rolled["ancestor_id"], "left").drop("ancestor_id")
