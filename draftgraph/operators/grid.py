"""Structural grid lines: long lines along an axis with a grid label at an end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..tables import grows
from .spatial import near_join


def nearest_label(points: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """plan_id, pord, l_ord, l_text: the label (plan_id, l_ord, l_text, lx, ly) whose centre is nearest to
    the point (plan_id, pord, px, py), closer than ``reach``; of equally near ones the first."""
    d = G.length("px", "py", "lx", "ly")
    box = lambda x, y: (F.col(x), F.col(y), F.col(x), F.col(y))
    pairs = near_join(points, labels, box("px", "py"), box("lx", "ly"), reach, 2 * max(reach, 1.0), d < reach)
    best = pairs.groupBy("plan_id", "pord").agg(F.min_by(F.struct("l_ord", "l_text"), F.struct(d.alias("d"), F.col("l_ord").alias("o"))).alias("l"))
    return best.select("plan_id", "pord", F.col("l.l_ord").alias("l_ord"), F.col("l.l_text").alias("l_text"))


def grid_candidates(paths: DataFrame, regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, ord, axis, label, l_ord, x0, y0, x1, y1, length: the label of the start before that of the end."""
    size = G.length("x0", "y0", "x1", "y1")
    lines = paths.filter((F.col("kind") == "line") & (size >= config.grid_line_min_length)).select("plan_id", "ord", "x0", "y0", "x1", "y1", size.alias("length"), G.axis(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), config.grid_line_axis_tolerance_deg).alias("axis"))
    lines = lines.filter("axis IS NOT NULL")
    labels = regions.filter("classification = 'grid_label'").select("plan_id", F.col("ord").alias("l_ord"), F.col("text").alias("l_text"), G.midpoint("bx0", "bx1").alias("lx"), G.midpoint("by0", "by1").alias("ly"))
    points = lines.select("plan_id", (F.col("ord") * 2).alias("pord"), F.col("x0").alias("px"), F.col("y0").alias("py")).union(lines.select("plan_id", F.col("ord") * 2 + 1, "x1", "y1"))
    found = nearest_label(points, labels, config.grid_label_proximity)
    best = found.groupBy("plan_id", F.floor(F.col("pord") / 2).cast("int").alias("ord")).agg(F.min_by(F.struct("l_ord", "l_text"), "pord").alias("l"))
    return lines.join(grows(best), ["plan_id", "ord"]).select("plan_id", "ord", "axis", F.col("l.l_text").alias("label"), F.col("l.l_ord").alias("l_ord"), "x0", "y0", "x1", "y1", "length")


def grid_lines(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, links): one line for each axis, label and rounded position, with the id of its first
    candidate and the place of its longest; links (plan_id, l_ord, grid_id) name each label used."""
    at = F.when(F.col("axis") == "horizontal", G.midpoint("y0", "y1")).otherwise(G.midpoint("x0", "x1"))
    rows = candidates.withColumn("position", F.bround(at, 0))
    line = rows.groupBy("plan_id", "axis", "label", "position").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct("length", (-F.col("ord")).alias("o"))).alias("g"), F.collect_set("l_ord").alias("l_ords")
    )
    gid = F.concat(F.lit("g-"), F.lpad(F.col("ord").cast("string"), 6, "0"))
    lines = line.select("plan_id", "ord", gid.alias("grid_id"), "axis", "label", F.col("g.x0").alias("x0"), F.col("g.y0").alias("y0"), F.col("g.x1").alias("x1"), F.col("g.y1").alias("y1"), F.lit("long_axis_aligned_line_with_label").alias("rule_triggered"))
    links = line.select("plan_id", F.explode("l_ords").alias("l_ord"), gid.alias("grid_id"))
    return lines, links


def detect_grid(paths: DataFrame, regions: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    return grid_lines(grid_candidates(paths, regions, config))
