"""Walls: pairs of parallel segments, without duplicates, tagged and filtered by thickness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..schemas import WALLS_RAW
from ..tables import grows, materialize
from .graph import cluster_points
from .spatial import near_join, prefixed

CELL = 128.0
ROUNDING = 1e-9


def _clip(t, ta, tb, a, b):
    """The coordinate at parameter t of a segment whose ends have the parameters ta and tb."""
    return F.when(F.abs(tb - ta) < 1e-9, a).otherwise(a + (t - ta) / (tb - ta) * (b - a))


def parallel_pairs(segs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The centre lines of pairs i < j of nearly parallel segments that run beside each other.

    Angles go to bins of the tolerance's width; j's box is widened by the largest thickness and its
    own drift, so that every pair meets in a cell of the grid and a neighbouring bin.
    """
    tol, low, high = config.parallel_angle_tolerance, config.wall_min_thickness, config.wall_max_thickness
    bins = max(1, int(180 // tol))
    bin_of = F.least(F.floor(F.col("angle") / (180.0 / bins)), F.lit(bins - 1)).cast("int")
    a = prefixed(segs, "i_").withColumn("bin", F.least(F.floor(F.col("i_angle") / (180.0 / bins)), F.lit(bins - 1)).cast("int"))
    b = segs.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of, F.pmod(bin_of + 1, F.lit(bins)), F.pmod(bin_of - 1 + bins, F.lit(bins))))))
    b = prefixed(b, "j_", ("plan_id", "bin"))
    key = F.struct("plan_id", "bin")
    a, b = a.withColumn("__key", key).drop("bin"), b.withColumn("__key", key).drop("plan_id", "bin")
    thickness = G.line_distance("i_x0", "i_y0", "i_x1", "i_y1", G.midpoint("j_x0", "j_x1"), G.midpoint("j_y0", "j_y1"))
    first = (F.col("i_ord") < F.col("j_ord")) & (G.angle_difference("i_angle", "j_angle") <= tol) & (thickness >= low) & (thickness <= high)
    drift = float(np.sin(np.radians(tol)))
    # the wider side is j; near_join widens its left argument
    pairs = near_join(b, a, tuple(F.col(f"j_{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"i_{c}") for c in ("x0", "y0", "x1", "y1")), high, CELL, first, by="__key", left_reach=F.lit(high) + drift * F.col("j_length")).drop("__key")

    ux, uy = (F.col("i_x1") - F.col("i_x0")) / F.col("i_length"), (F.col("i_y1") - F.col("i_y0")) / F.col("i_length")
    p = pairs.withColumns({"thickness": thickness, "ta": G.projection("j_x0", "j_y0", "i_x0", "i_y0", ux, uy), "tb": G.projection("j_x1", "j_y1", "i_x0", "i_y0", ux, uy), "ti": G.projection("i_x1", "i_y1", "i_x0", "i_y0", ux, uy)})
    p = p.withColumns({"lo": F.greatest(F.least(F.lit(0.0), F.col("ti")), F.least("ta", "tb")), "hi": F.least(F.greatest(F.lit(0.0), F.col("ti")), F.greatest("ta", "tb"))})
    p = p.withColumn("overlap_length", F.col("hi") - F.col("lo"))
    p = p.filter((F.col("overlap_length") > 0) & (F.col("overlap_length") >= config.wall_min_overlap_ratio * F.least("i_length", "j_length")))
    at = lambda t, c: (_clip(F.col(t), F.lit(0.0), F.col("ti"), F.col(f"i_{c}0"), F.col(f"i_{c}1")) + _clip(F.col(t), F.col("ta"), F.col("tb"), F.col(f"j_{c}0"), F.col(f"j_{c}1"))) / 2.0
    p = p.withColumns({"x0": at("lo", "x"), "y0": at("lo", "y"), "x1": at("hi", "x"), "y1": at("hi", "y")})
    p = p.withColumns({"length": G.length("x0", "y0", "x1", "y1"), "angle_degrees": G.angle(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))}).filter("length >= 1e-6")
    square = G.is_orthogonal("angle_degrees", config.orthogonal_angle_tolerance)
    base = [F.lit("parallel_pairing"), F.lit("thickness_in_range")]
    return p.select(
        "plan_id", "i_ord", "j_ord", F.concat_ws("-", F.lit("w"), "i_ord", "j_ord").alias("segment_id"),
        "x0", "y0", "x1", "y1", "length", "angle_degrees", "thickness",
        (0.5 * (F.col("i_stroke_width") + F.col("j_stroke_width"))).alias("stroke_width"),
        F.zip_with("i_rgb", "j_rgb", lambda u, v: 0.5 * (u + v)).alias("color_rgb"),
        (F.col("i_is_dashed") | F.col("j_is_dashed")).alias("is_dashed"),
        F.coalesce(F.nullif("i_layer_name", F.lit("")), "j_layer_name").alias("layer_name"),
        F.array("i_path_id", "j_path_id").alias("source_path_ids"),
        F.when(square, F.array(*base, F.lit("orthogonality"))).otherwise(F.array(*base)).alias("rules_passed"),
        F.when(square, F.array().cast("array<string>")).otherwise(F.array(F.lit("orthogonality"))).alias("rules_failed"),
        "overlap_length",
    )


def drop_duplicates(walls: DataFrame, tolerance: float) -> DataFrame:
    """Longest first, a wall stays unless its middle and its angle are within ``tolerance`` of one that
    stayed. The rule depends on what was kept before, so each drawing is walked through in order,
    with kept walls in a grid of cells."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ord"], ascending=[False, True], kind="stable").reset_index(drop=True)
        mx, my, ang = ((pdf.x0 + pdf.x1) / 2).to_numpy(), ((pdf.y0 + pdf.y1) / 2).to_numpy(), pdf.angle_degrees.to_numpy()
        size = max(tolerance, 1e-9)
        kept: dict[tuple[int, int], list[int]] = {}
        stay = []
        for k in range(len(pdf)):
            cx, cy = int(mx[k] // size), int(my[k] // size)
            near = (m for dx in (-1, 0, 1) for dy in (-1, 0, 1) for m in kept.get((cx + dx, cy + dy), ()))
            for m in near:
                d = abs(ang[k] - ang[m]) % 180.0
                if np.hypot(mx[k] - mx[m], my[k] - my[m]) <= tolerance and min(d, 180.0 - d) <= tolerance:
                    break
            else:
                kept.setdefault((cx, cy), []).append(k)
                stay.append(k)
        out = pdf.iloc[stay].copy()
        out["ord"] = np.arange(len(out), dtype=np.int32)
        return out

    numbered = walls.withColumn("ord", (F.row_number().over(Window.partitionBy("plan_id").orderBy("i_ord", "j_ord")) - 1).cast("int")).drop("i_ord", "j_ord")
    names = [c.split()[0] for c in WALLS_RAW.split(", ")]
    return numbered.select(*names).groupBy("plan_id").applyInPandas(keep, WALLS_RAW)


def structural_junctions(segs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, jord, jx, jy: centres of clusters of enough segment ends, in drawings of enough segments."""
    ends = segs.select("plan_id", (F.col("ord") * 2).alias("eord"), F.col("x0").alias("x"), F.col("y0").alias("y")).union(segs.select("plan_id", (F.col("ord") * 2 + 1).alias("eord"), "x1", "y1"))
    clusters = cluster_points(ends, "eord", config.junction_raw_snap_radius)
    many = segs.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= config.junction_anchor_min_segments).select("plan_id")
    found = clusters.groupBy("plan_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("jx"), F.avg("y").alias("jy"))
    return found.filter(F.col("n") >= config.junction_anchor_min_cluster_size).join(grows(many), "plan_id").select("plan_id", F.col("cluster").alias("jord"), "jx", "jy")


def nearest_junction(points: DataFrame, junctions: DataFrame, tolerance: float) -> DataFrame:
    """plan_id, pord, jx, jy for each point (plan_id, pord, px, py) with a junction in reach; of equally
    near ones the last."""
    d2 = (F.col("px") - F.col("jx")) * (F.col("px") - F.col("jx")) + (F.col("py") - F.col("jy")) * (F.col("py") - F.col("jy"))
    box = lambda x, y: (F.col(x), F.col(y), F.col(x), F.col(y))
    pairs = near_join(points, junctions, box("px", "py"), box("jx", "jy"), tolerance, 4 * max(tolerance, 1.0), d2 <= tolerance * tolerance)
    best = pairs.groupBy("plan_id", "pord").agg(F.min_by(F.struct("jx", "jy"), F.struct(d2.alias("d"), (-F.col("jord")).alias("o"))).alias("j"))
    return best.select("plan_id", "pord", F.col("j.jx").alias("jx"), F.col("j.jy").alias("jy"))


def anchor(walls: DataFrame, segs: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(walls, dropped): walls tagged by how many ends are at structural junctions; in filter mode those
    without are dropped and the others' ends move to the junctions."""
    none = walls.limit(0)
    if not (config.junction_anchor_enabled or config.junction_anchor_tag_only):
        return walls, none
    junctions = structural_junctions(segs, config)
    points = walls.select("plan_id", (F.col("ord") * 2).alias("pord"), F.col("x0").alias("px"), F.col("y0").alias("py")).union(walls.select("plan_id", (F.col("ord") * 2 + 1).alias("pord"), "x1", "y1"))
    snapped = nearest_junction(points, junctions, config.junction_anchor_snap_tolerance)
    ends = snapped.groupBy("plan_id", F.floor(F.col("pord") / 2).cast("int").alias("ord")).agg(
        F.max(F.when(F.col("pord") % 2 == 0, F.struct("jx", "jy"))).alias("s"), F.max(F.when(F.col("pord") % 2 == 1, F.struct("jx", "jy"))).alias("e")
    )
    active = junctions.select("plan_id").distinct().withColumn("__active", F.lit(True))
    rows = walls.join(grows(ends), ["plan_id", "ord"], "left").join(grows(active), "plan_id", "left").withColumn("__active", F.coalesce("__active", F.lit(False)))
    loose = F.col("__active") & F.col("s").isNull() & F.col("e").isNull()
    tag = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.lit("junction_anchored_both")).otherwise(F.lit("junction_anchored_one"))
    rows = rows.withColumns({
        "rules_failed": F.when(loose, F.array_append("rules_failed", F.lit("no_junction_anchor"))).otherwise(F.col("rules_failed")),
        "__loose": loose,
    })
    anchored = F.col("__active") & ~F.col("__loose")
    if config.junction_anchor_enabled and not config.junction_anchor_tag_only:
        move = lambda c, j, k: F.when(anchored & F.col(j).isNotNull(), F.col(f"{j}.{k}")).otherwise(F.col(c))
        rows = rows.withColumns({"x0": move("x0", "s", "jx"), "y0": move("y0", "s", "jy"), "x1": move("x1", "e", "jx"), "y1": move("y1", "e", "jy")})
        size = G.length("x0", "y0", "x1", "y1")
        rows = rows.withColumn("__flat", anchored & (size < 1e-6))
        rows = rows.withColumns({
            "length": F.when(anchored & ~F.col("__flat"), size).otherwise(F.col("length")),
            "angle_degrees": F.when(anchored & ~F.col("__flat"), G.angle(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).otherwise(F.col("angle_degrees")),
            "rules_failed": F.when(F.col("__flat"), F.array_append("rules_failed", F.lit("collapsed_anchor_snap"))).otherwise(F.col("rules_failed")),
            "rules_passed": F.when(anchored & ~F.col("__flat"), F.array_append("rules_passed", tag)).otherwise(F.col("rules_passed")),
        })
        gone = F.col("__loose") | F.col("__flat")
        return rows.filter(~gone).select(*walls.columns), rows.filter(gone).select(*walls.columns)
    rows = rows.withColumn("rules_passed", F.when(anchored, F.array_append("rules_passed", tag)).otherwise(F.col("rules_passed")))
    return rows.select(*walls.columns), none


def tag_outliers(walls: DataFrame) -> DataFrame:
    """Information alone: thickness further than two standard deviations from the drawing's mean. Both are
    rounded sums, whose last bits follow the order of rows: a wall at two of them, but for that, is none."""
    plan = Window.partitionBy("plan_id")
    rows = walls.withColumns({"__m": F.avg("thickness").over(plan), "__s": F.stddev_pop("thickness").over(plan)})
    out = (F.col("__s") > 0) & (F.abs(F.col("thickness") - F.col("__m")) - 2.0 * F.col("__s") > ROUNDING * F.abs(F.col("__m")))
    add = lambda c, tag: F.when(F.array_contains(c, tag), F.col(c)).otherwise(F.array_append(c, F.lit(tag)))
    return rows.withColumns({"rules_failed": F.when(out, add("rules_failed", "thickness_outlier")).otherwise(F.col("rules_failed")), "rules_passed": F.when(~out, add("rules_passed", "thickness_consistent")).otherwise(F.col("rules_passed"))}).drop("__m", "__s")


def thickness_bins(walls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, bin, weight, t_min, t_max, mean, support: a histogram weighted by length for drawings of
    enough walls; where no wall has a length, each weighs one."""
    width = config.thickness_cluster_bin_width
    plan = Window.partitionBy("plan_id")
    w = walls.select("plan_id", "thickness", F.coalesce("length", F.lit(0.0)).alias("length"))
    w = w.withColumns({"n": F.count(F.lit(1)).over(plan), "t_min": F.min("thickness").over(plan), "t_max": F.max("thickness").over(plan), "any": F.max(F.col("length") > 0).over(plan)}).filter(F.col("n") >= config.thickness_cluster_min_candidates)
    w = w.withColumn("weight", F.when(F.col("any"), F.col("length")).otherwise(F.lit(1.0)))
    stats = w.groupBy("plan_id").agg(
        F.first("t_min").alias("t_min"), F.first("t_max").alias("t_max"), (F.sum(F.col("thickness") * F.col("weight")) / F.sum("weight")).alias("mean"),
        (F.when(F.max("any"), F.greatest(F.percentile(F.when(F.col("length") > 0, F.col("length")), F.lit(0.5)), F.lit(1.0))).otherwise(F.lit(1.0)) * float(config.thickness_cluster_min_support)).alias("support"),
    )
    bins = w.groupBy("plan_id", F.floor((F.col("thickness") - F.col("t_min")) / width).cast("int").alias("bin")).agg(F.sum("weight").alias("weight"))
    return bins.join(grows(stats), "plan_id")


def thickness_modes(walls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, mode: centres of the heaviest peaks. A peak has the support, more weight than the three
    bins to its left and no less than the three to its right; absent bins weigh nothing."""
    width = config.thickness_cluster_bin_width
    bins = thickness_bins(walls, config)
    order = Window.partitionBy("plan_id").orderBy("bin")
    left = F.max("weight").over(order.rangeBetween(-3, -1))
    right = F.max("weight").over(order.rangeBetween(1, 3))
    single = F.col("t_max") - F.col("t_min") < width
    peaks = bins.withColumns({"left": left, "right": right}).filter(single | ((F.col("weight") >= F.col("support")) & (F.coalesce("left", F.lit(-1.0)) < F.col("weight")) & (F.coalesce("right", F.lit(0.0)) <= F.col("weight"))))
    peaks = peaks.withColumn("rank", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("weight").desc(), "bin"))).filter(F.col("rank") <= F.when(single, 1).otherwise(config.thickness_cluster_max_modes))
    mode = F.when(single, F.col("mean")).otherwise(F.col("t_min") + (F.col("bin") + 0.5) * width)
    return peaks.select("plan_id", mode.alias("mode")).filter(F.col("mode") <= config.thickness_cluster_mode_max_realistic)


def split_by_thickness(walls: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): walls near one of their drawing's modes; all stay where it has none."""
    modes = thickness_modes(walls, config).groupBy("plan_id").agg(F.collect_list("mode").alias("modes"))
    rows = walls.join(grows(modes), "plan_id", "left")
    near = F.exists("modes", lambda m: F.abs(F.col("thickness") - m) <= config.thickness_cluster_tolerance * m)
    kept = rows.filter(F.col("modes").isNull() | near).withColumn("rules_passed", F.when(F.col("modes").isNotNull(), F.array_append("rules_passed", F.lit("thickness_cluster_member"))).otherwise(F.col("rules_passed")))
    dropped = rows.filter(F.col("modes").isNotNull() & ~near).withColumn("rules_failed", F.array_append("rules_failed", F.lit("thickness_cluster_outlier")))
    return kept.drop("modes"), dropped.drop("modes")


def detect_walls(classified: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(walls, dropped) of classified paths."""
    from .classify import segments

    segs = materialize(segments(classified), "segments")
    walls = materialize(drop_duplicates(parallel_pairs(segs, config), config.junction_snap_distance), "walls-deduped")
    walls, loose = anchor(walls, segs, config)
    walls = materialize(walls, "walls-anchored")
    kept, dropped = split_by_thickness(tag_outliers(walls), config)
    return kept, dropped.unionByName(loose)
