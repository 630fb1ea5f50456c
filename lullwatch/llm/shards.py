"""K-d tree sharding by bytes: nodes are split at weighted medians along their widest metadata dimension until one shard is left in each.

A node of k shards is cut where the bytes below reach floor(k/2)/k of its bytes. The cut is a value of the widest dimension (relative to the whole
table), then of the text's CRC-32 and of a hash of doc_id for rows that agree, so a value, source or group of copies of any size can be cut
exactly. A cut by doc_id, lang or source also runs through groups of equal texts, whatever their size: sizes come first. All nodes of a level are cut together: a pass sums bytes per node and bin, and
the bin that holds the target is refined until it is smaller than ``TOLERANCE`` of a shard. Only sums of at most ``BINS`` bins for each
node come to the driver; rows are never moved to find a cut. Everything is DataFrame functions.

Law: ``bytes``. Slots number a shard's rows from 0 without gaps, by parts of the shard whose sizes are summed first.

Defined results: a null text has size 16 and the CRC-32 of an empty text; null metadata takes one fixed place of its dimension; repeated rows each
have a slot; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullwatch.llm.common import partitions, register, stage, table

BINS = 512
TOLERANCE = 0.002
ROW_BYTES = 16
INF = float("inf")


def coordinates(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and the numbers that cuts refer to: dimensions x0.. and the tie keys t, u."""
    def name(c):
        return (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(2.0**32)) if c in docs.columns else F.lit(0.0)

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(raw) + ROW_BYTES).cast("bigint")
    key = F.xxhash64("doc_id")
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("x0"), F.log(size).alias("x1"),
        name("lang").alias("x2"), name("source").alias("x3"), F.crc32(raw).cast("double").alias("t"), F.shiftrightunsigned(key, 11).cast("double").alias("u"))


DIMENSIONS = ("x0", "x1", "x2", "x3")


def left_of(cut: dict) -> Column:
    keys, at = cut["keys"], cut["at"]
    test = F.col(keys[-1]) <= F.lit(at[-1])
    for k, v in reversed(list(zip(keys[:-1], at[:-1], strict=True))):
        test = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & test)
    return test


def place(tree: dict, node: int) -> Column:
    """Number of the leaf a row falls into: the cuts as nested conditions."""
    if node not in tree:
        return F.lit(node)
    return F.when(left_of(tree[node]), place(tree, 2 * node + 1)).otherwise(place(tree, 2 * node + 2))


def choose(search: dict, bins: list, slack: float) -> None:
    """One refinement step of a node's cut from its (bin, bytes, least, greatest) sums."""
    below = search["below"]
    for _, size, low, high in sorted(bins):
        if below + size >= search["target"]:
            break
        below += size
    keys, k = search["keys"], len(search["at"])
    search["below"] = below
    if low < high and size > slack:
        search["low"], search["high"] = low, high
    elif low < high or k == len(keys) - 1 or size <= slack:
        nearer = search["target"] - below > below + size - search["target"]
        end = high if nearer else low
        search["cut"] = {"keys": keys[:k + 1], "at": [*search["at"], end]} if nearer else {"keys": keys, "at": [*search["at"], end, *[-INF] * (len(keys) - k - 1)]}
        if not nearer and k == len(keys) - 1:
            search["cut"]["at"][-1] = end - 0.5
    else:
        search["at"].append(low)
        search["low"] = search["high"] = None


def split(points: DataFrame, shards: int) -> dict:
    """Cuts of all inner nodes; node n has the children 2n+1 and 2n+2."""
    total = points.agg(F.sum("size"), *[F.max(c) - F.min(c) for c in DIMENSIONS]).first()
    if not total[0]:
        return {}
    spread = [w or 1.0 for w in total[1:]]
    slack = TOLERANCE * total[0] / shards
    tree: dict[int, dict] = {}
    level = {0: shards}
    while any(k > 1 for k in level.values()):
        rows = points.withColumn("node", place(tree, 0)).where(F.col("node").isin([n for n, k in level.items() if k > 1]))
        stats = rows.groupBy("node").agg(F.sum("size").alias("size"), *[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        open_cuts = {}
        for r in stats:
            widths = [(r[f"hi_{c}"] - r[f"lo_{c}"]) / s for c, s in zip(DIMENSIONS, spread, strict=True)]
            widest = DIMENSIONS[widths.index(max(widths))]
            keys = [widest, "t", "u"] if max(widths) > 0 else ["t", "u"]
            first = (r[f"lo_{widest}"], r[f"hi_{widest}"]) if max(widths) > 0 else (None, None)
            open_cuts[r["node"]] = {"keys": keys, "at": [], "low": first[0], "high": first[1], "below": 0, "target": r["size"] * (level[r["node"]] // 2) / level[r["node"]]}
        while active := {n: s for n, s in open_cuts.items() if "cut" not in s}:
            refine(rows, active, slack)
        tree |= {n: s["cut"] for n, s in open_cuts.items()}
        level = {c: k for n, s in level.items() if s > 1 and n in tree for c, k in ((2 * n + 1, s // 2), (2 * n + 2, s - s // 2))} | {n: 1 for n, s in level.items() if s == 1}
    return tree


def refine(rows: DataFrame, active: dict[int, dict], slack: float) -> None:
    """One pass over the rows for all open cuts."""
    value, inside = F.lit(None).cast("double"), F.lit(False)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for n, s in active.items():
        here, key = F.col("node") == n, s["keys"][len(s["at"])]
        same = here
        for k, v in zip(s["keys"], s["at"], strict=False):
            same = same & (F.col(k) == F.lit(v))
        if s["low"] is not None:
            same = same & F.col(key).between(s["low"], s["high"])
        bounds = (s["low"], s["high"]) if s["low"] is not None else ((0.0, 2.0**32) if key == "t" else (0.0, 2.0**53))
        value, inside = F.when(here, F.col(key)).otherwise(value), inside | same
        low, high = F.when(here, F.lit(float(bounds[0]))).otherwise(low), F.when(here, F.lit(float(bounds[1]))).otherwise(high)
    bins = rows.where(inside).select("node", "size", value.alias("v"), low.alias("low"), high.alias("high"))
    bins = bins.withColumn("bin", F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(F.lit(0)))
    sums: dict[int, list] = {}
    for r in bins.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.min("v").alias("least"), F.max("v").alias("greatest")).collect():
        sums.setdefault(r["node"], []).append((r["bin"], r["size"], r["least"], r["greatest"]))
    for n, s in active.items():
        choose(s, sums[n], slack)


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; without ``shards``, as many as ``target_bytes`` asks for."""
    points = stage(coordinates(docs), "kd-points")
    if shards is None:
        shards = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    tree = split(points, shards)
    leaves = sorted(leaf_order(tree, 0))
    number = F.create_map(*[F.lit(x) for k, n in enumerate(leaf for _, leaf in leaves) for x in (n, k)])
    parts = max(4, partitions(docs.sparkSession))
    rows = points.select("doc_id", "size", "text_crc32", number[place(tree, 0)].alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).alias("part"))
    counts = rows.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("own")).cast("bigint").alias("slot"))


def leaf_order(tree: dict, node: int, path: str = "") -> list[tuple[str, int]]:
    if node not in tree:
        return [(path, node)]
    return leaf_order(tree, 2 * node + 1, path + "0") + leaf_order(tree, 2 * node + 2, path + "1")


@register("op5_kd_shards")
def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
