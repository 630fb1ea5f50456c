"""Linear scheme: sensors placed on a synthetic axis by the pickets of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.functions.pickets import PICKET_M, parse_pickets
from lullwatch.functions.risk import ALERT_LEVELS, LEVELS
from lullwatch.functions.text import geojson, wkt_line, wkt_point
from lullwatch.operators.tree import closure, paths
from lullwatch.operators.windows import clusters

# ---- fixed values: drawing distances in metres ------------------------------------------------------------------------
SIDE_M, STACK_M, NODE_X_M, MIN_LENGTH_M, MARGIN_M = 4.0, 1.5, -60.0, 100.0, 150.0
MIN_GALLERY_M, AXIS_TAIL_M, NODE_STEP_M, ZONE_GAP_M = 30.0, 20.0, 25.0, 50.0
# ------------------------------------------------------------------------------------------------------------------------


def complex_of(channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Channels with the complex (level 2) they belong to; channels outside a complex are dropped."""
    level2 = objects.filter(F.col("level") == 2).select(F.col("id").alias("complex_id"))
    up = closure(objects).withColumnRenamed("ancestor_id", "complex_id").join(level2, "complex_id").select(
        "complex_id", F.col("id").alias("object_id"))
    return channels.join(up, "object_id")


def located(channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Channels of complexes with parsed pickets; a gallery without its own anchor takes the smallest known one."""
    p = parse_pickets(complex_of(channels, objects))
    anchors = p.filter(F.col("gallery_m").isNotNull() & F.col("main_m").isNotNull()).groupBy("complex_id", "gallery").agg(
        F.min("main_m").alias("_anchor"))
    p = p.join(anchors, ["complex_id", "gallery"], "left")
    in_gallery = F.col("gallery_m").isNotNull()
    return p.withColumns({
        "anchor_m": F.when(in_gallery, F.coalesce("main_m", "_anchor", F.lit(0.0))),
        "placed_by": F.when(in_gallery, "gallery").when(F.col("main_m").isNotNull(), "picket").otherwise("node"),
        "up": in_gallery & F.coalesce(F.col("gallery").try_cast("int") % 2 == 1, F.lit(False)),
    }).drop("_anchor")


def galleries(loc: DataFrame) -> DataFrame:
    """Galleries by complex, name and anchor with their length and direction."""
    g = loc.filter(F.col("gallery_m").isNotNull())
    return g.groupBy("complex_id", "gallery", "anchor_m", "up").agg(
        F.greatest(F.max("gallery_m") + PICKET_M, F.lit(MIN_GALLERY_M)).alias("length_m"))


def lanes(loc: DataFrame) -> DataFrame:
    """Axis length and vertical position of every complex: lanes go down, apart by their longest galleries."""
    axis = loc.groupBy("complex_id").agg(F.greatest(
        F.coalesce(F.max(F.greatest("main_m", "range_to")), F.lit(0.0)) + AXIS_TAIL_M, F.lit(MIN_LENGTH_M)).alias("length_m"))
    reach = galleries(loc).groupBy("complex_id").agg(
        F.max(F.when(F.col("up"), F.col("length_m"))).alias("_up"), F.max(F.when(~F.col("up"), F.col("length_m"))).alias("_down"))
    c = axis.join(reach, "complex_id", "left").withColumns({
        "_up": F.coalesce("_up", F.lit(0.0)) + MARGIN_M, "_down": F.coalesce("_down", F.lit(0.0)) + MARGIN_M})
    w = Window.orderBy("complex_id")  # one row per complex
    before = F.coalesce(F.sum(F.col("_up") + F.col("_down")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return c.withColumn("y0", -(before + F.col("_up"))).drop("_up", "_down")


def place(loc: DataFrame) -> DataFrame:
    """Coordinates of every channel; channels of one point stand four in a row, channels of a node six in a row.

    Ranks are taken inside a point or a node, in the order of channel ids.
    """
    p = loc.join(lanes(loc).select("complex_id", "y0"), "complex_id")
    side = F.col("side")
    on_axis = F.when(side == "left", SIDE_M).when(side == "right", -SIDE_M).otherwise(0.0)
    in_gallery = F.when(side == "right", SIDE_M).when(side == "left", -SIDE_M).otherwise(0.0)
    sign = F.when(F.col("up"), 1.0).otherwise(-1.0)
    pos = p.filter(F.col("placed_by") != "node").withColumns({
        "_x": F.when(F.col("placed_by") == "gallery", F.col("anchor_m") + in_gallery).otherwise(F.col("main_m")),
        "_y": F.when(F.col("placed_by") == "gallery", F.col("y0") + sign * F.greatest("gallery_m", F.lit(2.0))).otherwise(F.col("y0") + on_axis),
    })
    w = Window.partitionBy("complex_id", F.round("_x", 1), F.round("_y", 1)).orderBy("id")
    k = F.row_number().over(w) - 1
    pos = pos.withColumn("_k", k).withColumns({
        "x": F.col("_x") + (F.col("_k") % 4) * STACK_M,
        "y": F.col("_y") + F.floor(F.col("_k") / 4) * STACK_M * F.when(F.col("_y") >= F.col("y0"), 1.0).otherwise(-1.0)})
    node = p.filter(F.col("placed_by") == "node").join(nodes(loc).select("complex_id", "object_id", "node_y"), ["complex_id", "object_id"])
    j = F.row_number().over(Window.partitionBy("object_id").orderBy("id")) - 1
    node = node.withColumn("_k", j).withColumns({
        "x": NODE_X_M - (F.col("_k") % 6) * 4.0, "y": F.col("node_y") - F.floor(F.col("_k") / 6) * 4.0})
    return pos.drop("_x", "_y", "_k").unionByName(node.drop("_k", "node_y"))


def nodes(loc: DataFrame) -> DataFrame:
    """Points of sub-objects that hold channels without a picket: a column left of the axis start."""
    n = loc.filter(F.col("placed_by") == "node").select("complex_id", "object_id").distinct()
    i = F.row_number().over(Window.partitionBy("complex_id").orderBy("object_id")) - 1
    return n.withColumn("_i", i).join(lanes(loc).select("complex_id", "y0"), "complex_id").select(
        "complex_id", "object_id", F.lit(NODE_X_M).alias("node_x"), (F.col("y0") - F.col("_i") * NODE_STEP_M).alias("node_y"))


def sections(loc: DataFrame) -> DataFrame:
    """Stretch of the axis that each sub-object covers."""
    at = F.when(F.col("placed_by") == "gallery", F.col("anchor_m")).otherwise(F.col("main_m"))
    ranged = F.col("placed_by") == "picket"
    return loc.filter(F.col("placed_by") != "node").groupBy("complex_id", "object_id").agg(
        F.min(F.least(at, F.when(ranged, F.col("range_from")))).alias("x0"),
        F.max(F.greatest(at, F.when(ranged, F.col("range_to")))).alias("x1"))


def stats(channels: DataFrame, loc: DataFrame) -> DataFrame:
    by = lambda x: F.count_if(F.col("placed_by") == x)
    s = loc.agg(by("picket").alias("on_axis"), by("gallery").alias("in_gallery"), by("node").alias("in_node"))
    total = channels.agg(F.count(F.lit(1))).scalar()
    picket = parse_pickets(channels).agg(F.count_if(F.col("main_m").isNotNull() | F.col("gallery_m").isNotNull())).scalar()
    return s.withColumns({"channels": total, "with_picket": picket,
                          "without_complex": total - F.col("on_axis") - F.col("in_gallery") - F.col("in_node"),
                          "galleries": galleries(loc).agg(F.count(F.lit(1))).scalar()})


def problem_zones(placed: DataFrame, risk: DataFrame) -> DataFrame:
    """Stretches of the axis with alert channels close to each other. ``risk(id, risk_level, prob)``."""
    r = risk.filter(F.col("risk_level").isin(*ALERT_LEVELS))
    a = placed.filter(F.col("placed_by") == "picket").join(r, "id")
    return clusters(a, ["complex_id"], "x", ZONE_GAP_M, 2, [
        F.count_if(F.col("risk_level") == "critical").alias("critical"), F.round(F.max("prob"), 4).alias("max_prob")]).drop("cluster")


def _pt(x: Column, y: Column) -> Column:
    return F.array(F.round(x, 1), F.round(y, 1))


def channel_features(placed: DataFrame) -> DataFrame:
    """Channel points as WKT and GeoJSON geometry."""
    x, y = F.round("x", 1), F.round("y", 1)
    return placed.select("id", "placed_by", "side", "feature", wkt_point(x, y).alias("wkt"), geojson("Point", _pt(x, y)).alias("geometry"))


def line_features(loc: DataFrame) -> DataFrame:
    """Axes, galleries and sections as lines."""
    lane = lanes(loc)
    y0 = F.col("y0")
    shape = lambda kind, key, x0, ya, x1, yb: [
        F.lit(kind).alias("kind"), "complex_id", key.cast("string").alias("key"),
        wkt_line([(F.round(x0, 1), F.round(ya, 1)), (F.round(x1, 1), F.round(yb, 1))]).alias("wkt"),
        geojson("LineString", F.array(_pt(x0, ya), _pt(x1, yb))).alias("geometry")]
    axis = lane.select(*shape("collector", F.col("complex_id"), F.lit(0.0), y0, F.col("length_m"), y0))
    g = galleries(loc).withColumnRenamed("length_m", "g_m").join(lane, "complex_id")
    end = y0 + F.when(F.col("up"), 1.0).otherwise(-1.0) * F.col("g_m")
    gal = g.select(*shape("gallery", F.col("gallery"), F.col("anchor_m"), y0, F.col("anchor_m"), end))
    s = sections(loc).join(lane, "complex_id")
    sec = s.select(*shape("section", F.col("object_id"), F.col("x0"), y0 + 12.0, F.greatest("x1", F.col("x0") + 10.0), y0 + 12.0))
    return axis.unionByName(gal).unionByName(sec)


def node_features(loc: DataFrame) -> DataFrame:
    """Sub-objects without pickets as points of the node column."""
    n = nodes(loc)
    x, y = F.round("node_x", 1), F.round("node_y", 1)
    return n.select(F.lit("node").alias("kind"), "complex_id", F.col("object_id").cast("string").alias("key"), wkt_point(x, y).alias("wkt"),
                    geojson("Point", _pt(x, y)).alias("geometry"))


def zone_features(loc: DataFrame, placed: DataFrame, risk: DataFrame, objects: DataFrame) -> DataFrame:
    """Problem zones as stretches of the axis, ten metres longer at both ends, with their counts and the pickets they lie between."""
    z = problem_zones(placed, risk).join(lanes(loc).select("complex_id", "y0"), "complex_id")
    z = z.join(objects.select(F.col("id").alias("complex_id"), "name"), "complex_id", "left")
    lo, hi, y0 = F.round(F.col("x_from") - 10, 1), F.round(F.col("x_to") + 10, 1), F.col("y0")
    picket = lambda c: F.floor(F.col(c) / 10).cast("string")
    return z.select(F.lit("problem_zone").alias("kind"), "complex_id", F.concat(F.col("name"), F.lit(": ПК"), picket("x_from"), F.lit("–ПК"), picket("x_to")).alias("key"),
                    wkt_line([(lo, y0), (hi, y0)]).alias("wkt"), geojson("LineString", F.array(_pt(lo, y0), _pt(hi, y0))).alias("geometry"),
                    F.col("size").alias("channels"), "critical", "max_prob")


def collector_facts(loc: DataFrame, placed: DataFrame, risk: DataFrame, objects: DataFrame) -> DataFrame:
    """What goes with a collector's axis: name and path, length, galleries, channels and their levels. ``risk(id, risk_level, prob)``."""
    p = placed.select("id", "complex_id").join(risk.select("id", "risk_level"), "id", "left").groupBy("complex_id").agg(
        F.count(F.lit(1)).alias("channels"), *[F.count_if(F.col("risk_level") == x).alias(x) for x in LEVELS])
    g = galleries(loc).groupBy("complex_id").agg(F.count(F.lit(1)).alias("galleries"))
    top = F.coalesce(*[F.when(F.col(x) > 0, x) for x in reversed(LEVELS)])
    return (
        lanes(loc).select("complex_id", F.round("length_m", 1).alias("length_m"), F.floor(F.col("length_m") / 10).cast("int").alias("pk_max"))
        .join(objects.select(F.col("id").alias("complex_id"), "name"), "complex_id", "left")
        .join(paths(objects).withColumnRenamed("id", "complex_id"), "complex_id", "left").join(g, "complex_id", "left").join(p, "complex_id", "left")
        .withColumns({**{c: F.coalesce(c, F.lit(0)) for c in ("galleries", "channels", *LEVELS)}, "max_risk_level": top})
    )


def scheme_features(loc: DataFrame, placed: DataFrame, risk: DataFrame, objects: DataFrame) -> DataFrame:
    """All rows of the scheme but the channel points: axes, galleries, sections, nodes and problem zones."""
    return line_features(loc).unionByName(node_features(loc)).unionByName(zone_features(loc, placed, risk, objects), allowMissingColumns=True)
