"""Doors: arcs of a door's size near a wall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..tables import grows
from .spatial import near_join


def door_arcs(paths: DataFrame, config: Config = DEFAULT) -> DataFrame:
    chord = G.length("x0", "y0", "x1", "y1")
    arcs = paths.filter((F.col("kind") == "arc") & chord.between(config.door_arc_chord_min, config.door_arc_chord_max))
    return arcs.select("plan_id", F.col("ord").alias("a_ord"), "x0", "y0", "x1", "y1", chord.alias("chord"), G.midpoint("x0", "x1").alias("mx"), G.midpoint("y0", "y1").alias("my"))


def nearest_wall(points: DataFrame, walls: DataFrame, reach: float, order: str = "w_ord") -> DataFrame:
    """plan_id, a_ord, w_id, d: the wall (plan_id, w_ord, w_id, wx0, wy0, wx1, wy1) nearest to a point
    (plan_id, a_ord, mx, my), closer than ``reach``; of equally near ones the first."""
    d = G.segment_distance("mx", "my", "wx0", "wy0", "wx1", "wy1")
    pairs = near_join(points, walls, tuple(F.col(c) for c in ("mx", "my", "mx", "my")), tuple(F.col(c) for c in ("wx0", "wy0", "wx1", "wy1")), reach, 128.0, d < reach)
    best = pairs.groupBy("plan_id", "a_ord").agg(F.min_by(F.struct("w_id", d.alias("d")), F.struct(F.round(d, 9).alias("d"), F.col(order).alias("o"))).alias("w"))
    return best.select("plan_id", "a_ord", F.col("w.w_id").alias("w_id"), F.col("w.d").alias("d"))


def detect_openings(paths: DataFrame, walls: DataFrame, adjacency: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``adjacency`` (plan_id, segment_id, adjacent_room_ids, in room order) gives the two rooms joined."""
    arcs = door_arcs(paths, config)
    w = walls.select("plan_id", F.col("ord").alias("w_ord"), F.col("segment_id").alias("w_id"), F.col("x0").alias("wx0"), F.col("y0").alias("wy0"), F.col("x1").alias("wx1"), F.col("y1").alias("wy1"))
    near = nearest_wall(arcs.select("plan_id", "a_ord", "mx", "my"), w, config.door_to_wall_distance)
    rows = arcs.join(grows(near), ["plan_id", "a_ord"]).join(grows(adjacency.withColumnRenamed("segment_id", "w_id")), ["plan_id", "w_id"], "left")
    two = F.slice(F.coalesce("adjacent_room_ids", F.array().cast("array<string>")), 1, 2)
    return rows.select(
        "plan_id", F.col("a_ord").alias("ord"), F.concat(F.lit("o-"), F.lpad(F.col("a_ord").cast("string"), 6, "0")).alias("opening_id"), F.lit("door").alias("type"),
        F.col("mx").alias("x"), F.col("my").alias("y"), F.col("chord").alias("width"),
        F.array(F.array("x0", "y0"), F.array("mx", "my"), F.array("x1", "y1")).alias("swing_arc"),
        F.col("w_id").alias("wall_segment_id"), F.when(F.size(two) > 0, two).alias("connects_room_ids"),
        F.lit(0.6).alias("confidence"), F.lit("arc_chord_near_wall").alias("rule_triggered"),
    )
