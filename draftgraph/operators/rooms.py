"""Rooms: the faces that walls and bridged gaps enclose, with what stands in them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..functions import text as X
from ..tables import grows, materialize
from . import polygons
from .spatial import near_join
from .topology import outward

CELL = 256.0
RING = "array<struct<x: double, y: double>>"


def valid_edges(walls: DataFrame) -> DataFrame:
    """Walls with both ends, which differ."""
    ends = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    return walls.filter(ends & ~((F.abs(F.col("x0") - F.col("x1")) < 1e-9) & (F.abs(F.col("y0") - F.col("y1")) < 1e-9)))


def bridge_pairs(ends: DataFrame, reach: float, drift: float) -> DataFrame:
    """plan_id, a, b, gap and both places, for loose ends (plan_id, cluster, x, y, ux, uy; u points along
    the wall) whose walls run on into the gap between them."""
    a = ends.select("plan_id", F.col("cluster").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ux").alias("aux"), F.col("uy").alias("auy"))
    b = ends.select("plan_id", F.col("cluster").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("ux").alias("bux"), F.col("uy").alias("buy"))
    gap = G.length("ax", "ay", "bx", "by")
    gx, gy = (F.col("bx") - F.col("ax")) / gap, (F.col("by") - F.col("ay")) / gap
    cos = math.cos(math.radians(drift))
    box = lambda x, y: (F.col(x), F.col(y), F.col(x), F.col(y))
    far = (F.col("a") != F.col("b")) & (gap >= 1e-9) & (gap <= reach)
    pairs = near_join(a, b, box("ax", "ay"), box("bx", "by"), reach, 2 * max(reach, 1.0), far)
    aligned = (-(F.col("aux") * gx + F.col("auy") * gy) >= cos) & (F.col("bux") * gx + F.col("buy") * gy >= cos)
    return pairs.filter(aligned).select("plan_id", "a", "b", gap.alias("gap"), "ax", "ay", "bx", "by")


def mutual_bridges(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest, once each: plan_id, x0, y0, x1, y1."""
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "a").orderBy("gap", "b"))).filter("r = 1")
    back = best.select("plan_id", F.col("a").alias("b"), F.col("b").alias("a"))
    return best.join(grows(back), ["plan_id", "a", "b"]).filter("a < b").select("plan_id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1"))


def gap_bridges(walls: DataFrame, junctions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return mutual_bridges(bridge_pairs(outward(walls, junctions), config.room_gap_close_max_distance, config.room_gap_close_max_angle_drift_deg))


POLYGONS = f"plan_id long, face int, ring {RING}, holes array<{RING}>, area double, cx double, cy double, short double, long double"


def polygonize(lines: DataFrame) -> DataFrame:
    """The faces of each drawing's lines (plan_id, x0, y0, x1, y1), with net area, centre and the sides of
    the least rectangle at any angle. A drawing's line work is one planar graph, hence one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = pdf.plan_id.iloc[0]
        found = polygons.polygonize(pdf[["x0", "y0", "x1", "y1"]].sort_values(["x0", "y0", "x1", "y1"]).to_numpy().tolist())
        point = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
        rows = []
        for ring, holes in found:
            area, cx, cy = polygons.area_and_center(ring, holes)
            short, long = polygons.rectangle_sides(ring)
            rows.append((area, cx, cy, short, long, point(ring), [point(h) for h in holes]))
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        return pd.DataFrame([(plan, k, r[5], r[6], *r[:5]) for k, r in enumerate(rows)], columns=["plan_id", "face", "ring", "holes", "area", "cx", "cy", "short", "long"])

    return lines.select("plan_id", "x0", "y0", "x1", "y1").groupBy("plan_id").applyInPandas(run, POLYGONS)


def plausible(faces: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Large enough, and no sliver."""
    thin = (F.col("short") > 1e-9) & (F.col("long") / F.col("short") > config.room_max_aspect_ratio)
    return faces.filter((F.col("area") >= config.room_min_area) & (F.col("short") >= config.room_min_short_dimension) & ~thin)


def _box(ring):
    side = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")


def _boxed(rooms: DataFrame, *columns) -> DataFrame:
    x0, y0, x1, y1 = _box(F.col("ring"))
    return rooms.select("plan_id", "room", *columns, x0.alias("rx0"), y0.alias("ry0"), x1.alias("rx1"), y1.alias("ry1"))


_R = ("rx0", "ry0", "rx1", "ry1")


def points_in_rooms(points: DataFrame, rooms: DataFrame, holes: bool = True) -> DataFrame:
    """Pairs of points (plan_id, px, py, ...) and rooms (plan_id, room, ring, holes) strictly around them."""
    inside = G.in_polygon("ring", "holes", "px", "py") if holes else G.in_ring("ring", "px", "py")
    return near_join(points, _boxed(rooms, "ring", "holes"), tuple(F.col(c) for c in ("px", "py", "px", "py")), tuple(F.col(c) for c in _R), 0.0, CELL, inside).drop("ring", "holes", *_R)


def bounding_walls(walls: DataFrame, rooms: DataFrame, tolerance: float) -> DataFrame:
    """plan_id, room, segment_id: walls whose middle is near a room's outer ring."""
    mid = walls.select("plan_id", "segment_id", G.midpoint("x0", "x1").alias("mx"), G.midpoint("y0", "y1").alias("my"))
    near = G.ring_distance("ring", "mx", "my") <= tolerance
    return near_join(mid, _boxed(rooms, "ring"), tuple(F.col(c) for c in ("mx", "my", "mx", "my")), tuple(F.col(c) for c in _R), tolerance, CELL, near).select("plan_id", "room", "segment_id")


def label_type(labels, config: Config = DEFAULT):
    """(room_type, substring) of the first label in an array that matches any pattern."""
    return F.get(F.filter(F.transform(labels, lambda t: X.room_match(t, config)), lambda m: m.isNotNull()), F.lit(0))


def name_and_number(labels, pattern: str):
    """(name, number): the first label that is a room number, and the first other one that is not empty."""
    stripped = F.transform(labels, lambda t: X.strip(t))
    number = F.get(F.filter(F.transform(stripped, lambda t: X.number_or_group(t, pattern)), lambda n: n.isNotNull()), F.lit(0))
    name = F.get(F.filter(stripped, lambda t: (t != "") & ~t.rlike(pattern)), F.lit(0))
    return F.struct(name.alias("name"), number.alias("number"))


def fixture_types(fixtures: DataFrame, rooms: DataFrame) -> DataFrame:
    """plan_id, room, f_type, f_kind: the first fixture in a room that tells its type."""
    f = fixtures.select("plan_id", F.col("ord").alias("f_ord"), F.lower("type").alias("f_kind"), X.fixture_room("type").alias("f_type"), F.col("x").alias("px"), F.col("y").alias("py")).filter("f_type IS NOT NULL")
    best = points_in_rooms(f, rooms).groupBy("plan_id", "room").agg(F.min_by(F.struct("f_type", "f_kind"), "f_ord").alias("f"))
    return best.select("plan_id", "room", "f.f_type", "f.f_kind")


def detect_rooms(walls: DataFrame, junctions: DataFrame, texts: DataFrame, config: Config = DEFAULT, fixtures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rooms, adjacency): rooms by area, largest first; adjacency (plan_id, segment_id,
    adjacent_room_ids). ``texts`` are text blocks (plan_id, ord, text, box)."""
    lines = valid_edges(walls)
    every = lines.select("plan_id", "x0", "y0", "x1", "y1")
    bridges = materialize(gap_bridges(walls, junctions, config), "bridges") if config.room_gap_close_enabled else None
    if bridges is not None:
        every = every.unionByName(bridges)
    faces = plausible(polygonize(every), config)
    rooms = faces.withColumn("room", (F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("area").desc(), "face")) - 1).cast("int")).drop("face")
    rooms = materialize(rooms, "rooms")

    t = texts.select("plan_id", F.col("ord").alias("t_ord"), "text", G.midpoint("bx0", "bx1").alias("px"), G.midpoint("by0", "by1").alias("py"))
    inside = points_in_rooms(t, rooms).groupBy("plan_id", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_ord", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))).alias("labels"))
    near = materialize(bounding_walls(lines, rooms, config.room_boundary_tolerance), "bounding-walls")
    rid = F.concat(F.lit("r-"), F.lpad(F.col("room").cast("string"), 6, "0"))
    walls_of = near.groupBy("plan_id", "room").agg(F.array_sort(F.collect_set("segment_id")).alias("bounding_walls"))
    adjacency = near.groupBy("plan_id", "segment_id").agg(F.array_sort(F.collect_set(rid)).alias("adjacent_room_ids"))

    rows = rooms.join(grows(inside), ["plan_id", "room"], "left").join(grows(walls_of), ["plan_id", "room"], "left")
    rows = rows.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "bounding_walls": F.coalesce("bounding_walls", F.array().cast("array<string>"))})
    if fixtures is not None:
        rows = rows.join(fixture_types(fixtures, rooms), ["plan_id", "room"], "left")
    else:
        rows = rows.withColumns({"f_type": F.lit(None).cast("string"), "f_kind": F.lit(None).cast("string")})
    if bridges is not None:
        b = bridges.select("plan_id", "x0", "y0", "x1", "y1")
        pairs = near_join(b, _boxed(rooms, "ring"), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in _R), 0.0, CELL, G.ring_meets("ring", "x0", "y0", "x1", "y1"))
        rows = rows.join(grows(pairs.select("plan_id", "room", F.lit(True).alias("virtual")).distinct()), ["plan_id", "room"], "left")
    else:
        rows = rows.withColumn("virtual", F.lit(None).cast("boolean"))
    rows = rows.withColumns({"m": label_type(F.col("labels"), config), "n": name_and_number(F.col("labels"), config.text_room_number_pattern)})
    rule = (
        F.when(F.col("f_type").isNotNull(), F.concat(F.lit("fixture_match:"), "f_kind"))
        .when(F.col("m").isNotNull(), F.concat(F.lit("label_match:"), F.col("m.substring")))
        .when(F.coalesce("virtual", F.lit(False)), F.lit("polygon_closure_via_virtual_gap"))
        .otherwise(F.lit("polygon_closure"))
    )
    out = rows.select(
        "plan_id", "room", rid.alias("room_id"), "ring", "holes", "area", "cx", "cy", "bounding_walls", F.col("n.name").alias("room_name"), F.col("n.number").alias("room_number"),
        F.coalesce("f_type", "m.room_type", F.lit("unknown")).alias("room_type"), "labels", rule.alias("rule_triggered"), F.lit(False).alias("requires_cross_document_validation"),
    )
    return out, adjacency


def enclosing_rooms(regions: DataFrame, rooms: DataFrame) -> DataFrame:
    """plan_id, text_region_id, enclosing_room_id: the largest room whose outer ring is around a region's
    middle; holes do not count here."""
    p = regions.select("plan_id", "text_region_id", G.midpoint("bx0", "bx1").alias("px"), G.midpoint("by0", "by1").alias("py"))
    best = points_in_rooms(p, rooms, holes=False).groupBy("plan_id", "text_region_id").agg(F.min("room").alias("room"))
    return best.select("plan_id", "text_region_id", F.concat(F.lit("r-"), F.lpad(F.col("room").cast("string"), 6, "0")).alias("enclosing_room_id"))
