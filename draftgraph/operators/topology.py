"""Topology: walls are split where others end on them, ends are joined into junctions, and short
floating pieces are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..tables import grows, materialize
from .graph import cluster_points
from .spatial import near_join

CELL = 128.0


def body_touches(walls: DataFrame, snap: float) -> DataFrame:
    """plan_id, ord, t: where another wall's end touches the inside of wall ``ord``."""
    inside = max(snap, 1e-6)
    ends = walls.select("plan_id", F.col("ord").alias("e_ord"), F.col("x0").alias("ex"), F.col("y0").alias("ey")).union(walls.select("plan_id", F.col("ord").alias("e_ord"), F.col("x1").alias("ex"), F.col("y1").alias("ey")))
    size = G.length("x0", "y0", "x1", "y1")
    hosts = walls.select("plan_id", "ord", "x0", "y0", "x1", "y1", size.alias("size")).filter(F.col("size") >= 2 * inside)
    t = G.foot_parameter("ex", "ey", "x0", "y0", "x1", "y1")
    hit = (F.col("e_ord") != F.col("ord")) & (t >= inside / F.col("size")) & (t <= 1.0 - inside / F.col("size")) & (G.foot_distance("ex", "ey", "x0", "y0", "x1", "y1") <= snap)
    pairs = near_join(ends, hosts, tuple(F.col(c) for c in ("ex", "ey", "ex", "ey")), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), snap, CELL, hit)
    return pairs.select("plan_id", "ord", t.alias("t"))


def merged_bounds(cuts, size, inside: float):
    """From cut parameters to piece bounds: a bound closer than ``inside`` to the one before takes its
    place; the ends are 0 and 1."""
    all_cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(cuts, lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))))))
    least = inside / size
    fold = F.aggregate(
        all_cuts,
        F.array().cast("array<double>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= least), F.array_append(acc, t)).otherwise(F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), t)),
    )
    return F.transform(fold, lambda t, i: F.when(i == F.size(fold) - 1, F.lit(1.0)).when(i == 0, F.lit(0.0)).otherwise(t))


def split_walls(walls: DataFrame, snap: float) -> DataFrame:
    """Walls and pieces of walls, numbered anew by wall and place, with ``split_from``."""
    inside = max(snap, 1e-6)
    cuts = body_touches(walls, snap).groupBy("plan_id", "ord").agg(F.collect_set("t").alias("cuts"))
    size = G.length("x0", "y0", "x1", "y1")
    rows = walls.join(grows(cuts), ["plan_id", "ord"], "left").withColumn("__size", size)
    whole = F.col("cuts").isNull() | (F.col("__size") < 2 * inside)
    rows = rows.withColumn("__bounds", F.when(whole, F.array(F.lit(0.0), F.lit(1.0))).otherwise(merged_bounds(F.col("cuts"), F.col("__size"), inside)))
    rows = rows.withColumn("__whole", whole)
    pieces = rows.select("*", F.posexplode(F.slice("__bounds", 1, F.size("__bounds") - 1)).alias("__k", "__t0"))
    pieces = pieces.withColumn("__t1", F.get("__bounds", F.col("__k") + 1))
    at = lambda t, c: F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))
    pieces = pieces.withColumns({"__x0": at(F.col("__t0"), "x"), "__y0": at(F.col("__t0"), "y"), "__x1": at(F.col("__t1"), "x"), "__y1": at(F.col("__t1"), "y")})
    part = G.length("__x0", "__y0", "__x1", "__y1")
    pieces = pieces.filter(F.col("__whole") | (part >= inside))
    cut = lambda new, old: F.when(F.col("__whole"), F.col(old)).otherwise(new)
    pieces = pieces.withColumns({
        "split_from": F.when(~F.col("__whole"), F.col("segment_id")),
        "segment_id": cut(F.concat_ws("/", "segment_id", F.col("__k").cast("string")), "segment_id"),
        "length": cut(part, "length"),
        "__ord": F.row_number().over(Window.partitionBy("plan_id").orderBy("ord", "__k")) - 1,
    })
    pieces = pieces.withColumns({c: cut(F.col(f"__{c}"), c) for c in ("x0", "y0", "x1", "y1")})
    return pieces.withColumn("ord", F.col("__ord").cast("int")).select(*walls.columns, "split_from")


def wall_ends(walls: DataFrame) -> DataFrame:
    """plan_id, eord (twice the wall's number, and one more for its end), x, y, ox, oy (the other end)."""
    a = walls.select("plan_id", (F.col("ord") * 2).alias("eord"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    b = walls.select("plan_id", (F.col("ord") * 2 + 1).alias("eord"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    return a.union(b)


def centroids(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("plan_id", "cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("ends"))


def junction_types(arms: DataFrame) -> DataFrame:
    """plan_id, cluster, junction_type from arms (plan_id, cluster, cx, cy, ox, oy, eord): the directions
    of those with a length, in the order of the walls."""
    n = G.length("cx", "cy", "ox", "oy")
    way = F.when(n > 1e-9, F.struct(F.col("eord"), ((F.col("ox") - F.col("cx")) / n).alias("x"), ((F.col("oy") - F.col("cy")) / n).alias("y")))
    return arms.groupBy("plan_id", "cluster").agg(G.junction_type(F.sort_array(F.collect_list(way))).alias("junction_type"))


def connected(walls: DataFrame) -> DataFrame:
    """plan_id, segment_id, connected_segment_ids: the other walls at either junction, sorted."""
    at = walls.select("plan_id", "segment_id", F.explode(F.array_distinct(F.array("sc", "ec"))).alias("cluster"))
    here = at.groupBy("plan_id", "cluster").agg(F.collect_set("segment_id").alias("ids"))
    near = at.join(grows(here), ["plan_id", "cluster"]).groupBy("plan_id", "segment_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return near.select("plan_id", "segment_id", F.array_sort(F.array_except("ids", F.array("segment_id"))).alias("connected_segment_ids"))


def build_topology(walls_in: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walls, junctions, dropped). Walls get sc, ec (their junctions' numbers), start_junction_id and the
    like, snapped ends, and connected_segment_ids; walls whose ends fall together are gone."""
    snap = config.junction_snap_distance
    walls = materialize(split_walls(walls_in, snap), "walls-split")  # its ends, pieces and centres are joined below
    clustered = materialize(cluster_points(wall_ends(walls), "eord", snap), "wall-ends")
    centers = centroids(clustered).drop("ends")
    ends = clustered.select("plan_id", F.floor(F.col("eord") / 2).cast("int").alias("ord"), (F.col("eord") % 2).alias("side"), "cluster")
    s = ends.filter("side = 0").select("plan_id", "ord", F.col("cluster").alias("sc"))
    e = ends.filter("side = 1").select("plan_id", "ord", F.col("cluster").alias("ec"))
    at = lambda c, x, y: centers.select("plan_id", F.col("cluster").alias(c), F.col("cx").alias(x), F.col("cy").alias(y))
    rows = walls.drop("x0", "y0", "x1", "y1", "length").join(grows(s), ["plan_id", "ord"]).join(grows(e), ["plan_id", "ord"])
    rows = rows.join(grows(at("sc", "x0", "y0")), ["plan_id", "sc"]).join(grows(at("ec", "x1", "y1")), ["plan_id", "ec"])
    rows = rows.withColumn("length", G.length("x0", "y0", "x1", "y1")).filter((F.col("sc") != F.col("ec")) & (F.col("length") >= snap))
    rows = materialize(rows, "walls-snapped")

    arms = rows.select("plan_id", F.col("sc").alias("cluster"), F.col("x0").alias("cx"), F.col("y0").alias("cy"), F.col("x1").alias("ox"), F.col("y1").alias("oy"), (F.col("ord") * 2).alias("eord"))
    arms = arms.union(rows.select("plan_id", "ec", "x1", "y1", "x0", "y0", F.col("ord") * 2 + 1))
    types = junction_types(arms)
    kind = lambda c, name: types.select("plan_id", F.col("cluster").alias(c), F.col("junction_type").alias(name))
    rows = rows.join(grows(kind("sc", "start_junction_type")), ["plan_id", "sc"]).join(grows(kind("ec", "end_junction_type")), ["plan_id", "ec"])
    jid = lambda c: F.concat(F.lit("j-"), F.lpad(F.col(c).cast("string"), 6, "0"))
    rows = rows.withColumns({"start_junction_id": jid("sc"), "end_junction_id": jid("ec")})
    loose = (F.col("start_junction_type") == "endpoint") & (F.col("end_junction_type") == "endpoint") & (F.col("length") < config.isolated_max_length)
    rows = materialize(rows, "walls-typed")
    kept, dropped = rows.filter(~loose), rows.filter(loose)
    kept = kept.join(grows(connected(kept)), ["plan_id", "segment_id"])
    here = kept.select("plan_id", "segment_id", F.col("sc").alias("cluster")).union(kept.select("plan_id", "segment_id", "ec")).groupBy("plan_id", "cluster").agg(F.array_sort(F.collect_list("segment_id")).alias("connected_segment_ids"))
    junctions = here.join(grows(centers), ["plan_id", "cluster"]).join(grows(types), ["plan_id", "cluster"])
    junctions = junctions.select("plan_id", "cluster", jid("cluster").alias("junction_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "junction_type", "connected_segment_ids")
    return kept, junctions, dropped


def degrees(walls: DataFrame) -> DataFrame:
    """plan_id, cluster, degree: ends of walls at a junction."""
    return walls.select("plan_id", F.explode(F.array("sc", "ec")).alias("cluster")).groupBy("plan_id", "cluster").agg(F.count(F.lit(1)).alias("degree"))


def outward(walls: DataFrame, junctions: DataFrame) -> DataFrame:
    """plan_id, cluster, x, y, ux, uy: for junctions of one wall, the unit vector along it."""
    single = degrees(walls).filter("degree = 1").select("plan_id", "cluster")
    to = walls.select("plan_id", F.col("sc").alias("cluster"), F.col("x1").alias("ox"), F.col("y1").alias("oy")).union(walls.select("plan_id", "ec", "x0", "y0"))
    rows = to.join(grows(single), ["plan_id", "cluster"]).join(grows(junctions.select("plan_id", "cluster", "x", "y")), ["plan_id", "cluster"])
    n = G.length("x", "y", "ox", "oy")
    return rows.filter(n >= 1e-9).select("plan_id", "cluster", "x", "y", ((F.col("ox") - F.col("x")) / n).alias("ux"), ((F.col("oy") - F.col("y")) / n).alias("uy"))


def merge_gaps(walls: DataFrame, junctions: DataFrame, config: Config = DEFAULT, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Optional: junctions of one wall each, closer than ``gap_close_distance`` and in line or square to
    each other, are merged at their middle; nearest pairs that choose each other, in a few rounds.
    Off by default (distance 0)."""
    if config.gap_close_distance <= 0:
        return walls, junctions
    for _ in range(rounds):
        pairs = gap_candidates(walls, junctions, config)
        best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "a").orderBy("gap", "b"))).filter("r = 1").drop("r")
        back = best.select("plan_id", F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = best.join(grows(back), ["plan_id", "a", "b"]).filter("a < b").select("plan_id", F.col("a").alias("keep"), F.col("b").alias("gone"), "mx", "my")
        mutual = materialize(mutual, "gaps")
        if not mutual.limit(1).count():
            break
        move = mutual.select("plan_id", F.col("keep").alias("cluster"), "keep", "mx", "my").union(mutual.select("plan_id", "gone", "keep", "mx", "my"))
        for c, x, y, i in (("sc", "x0", "y0", "start_junction_id"), ("ec", "x1", "y1", "end_junction_id")):
            m = move.withColumnRenamed("cluster", c)
            walls = walls.join(grows(m), ["plan_id", c], "left")
            jid = F.concat(F.lit("j-"), F.lpad(F.col("keep").cast("string"), 6, "0"))
            walls = walls.withColumns({x: F.coalesce("mx", x), y: F.coalesce("my", y), i: F.coalesce(jid, F.col(i)), c: F.coalesce("keep", c)}).drop("keep", "mx", "my")
        walls = materialize(walls.withColumn("length", G.length("x0", "y0", "x1", "y1")), "walls-merged")
        junctions = junctions.join(grows(mutual.select("plan_id", F.col("gone").alias("cluster"))), ["plan_id", "cluster"], "left_anti")
        spot = mutual.select("plan_id", F.col("keep").alias("cluster"), "mx", "my")
        junctions = junctions.join(grows(spot), ["plan_id", "cluster"], "left").withColumns({"x": F.coalesce("mx", "x"), "y": F.coalesce("my", "y")}).drop("mx", "my")
        junctions = materialize(junctions, "junctions-merged")
    return walls, junctions


def gap_candidates(walls: DataFrame, junctions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, a, b, gap, mx, my: both directions of each pair of single-wall junctions in reach whose
    walls are in line with the gap or square to each other."""
    import math

    o = outward(walls, junctions)
    a = o.select("plan_id", F.col("cluster").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ux").alias("aux"), F.col("uy").alias("auy"))
    b = o.select("plan_id", F.col("cluster").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("ux").alias("bux"), F.col("uy").alias("buy"))
    gap = G.length("ax", "ay", "bx", "by")
    dot = F.abs(F.col("aux") * F.col("bux") + F.col("auy") * F.col("buy"))
    drift = math.radians(config.gap_close_max_angle_drift)
    reach = config.gap_close_distance
    box = lambda x, y: (F.col(x), F.col(y), F.col(x), F.col(y))
    pairs = near_join(a, b, box("ax", "ay"), box("bx", "by"), reach, 2 * max(reach, 1.0), (F.col("a") != F.col("b")) & (gap < reach) & ((dot >= math.cos(drift)) | (dot <= math.sin(drift))))
    return pairs.select("plan_id", "a", "b", gap.alias("gap"), G.midpoint("ax", "bx").alias("mx"), G.midpoint("ay", "by").alias("my"))
