"""Paths to candidates: an ordered classifier by stroke, and a rescue by length for whole drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..tables import grows
from .spatial import near_join

CELL = 64.0


def text_distance(paths: DataFrame, texts: DataFrame, reach: float) -> DataFrame:
    """plan_id, ord, near: the least distance from a path's middle to a text's box, where it is within
    ``reach`` (rows without a text in reach are missing)."""
    a = paths.select("plan_id", "ord", G.midpoint("x0", "x1").alias("mx"), G.midpoint("y0", "y1").alias("my"))
    b = texts.select("plan_id", "bx0", "by0", "bx1", "by1")
    near = G.box_distance("mx", "my", "bx0", "by0", "bx1", "by1")
    box = tuple(F.col(c) for c in ("mx", "my", "mx", "my"))
    pairs = near_join(a, b, box, tuple(F.col(c) for c in ("bx0", "by0", "bx1", "by1")), reach, CELL, near <= reach)
    return pairs.groupBy("plan_id", "ord").agg(F.min(near).alias("near"))


def classify_primary(paths: DataFrame, texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``paths`` with candidate_type, classification_confidence, rule_triggered. Texts are looked up for
    thin strokes alone."""
    width, light = F.coalesce("stroke_width", F.lit(0.0)), G.lightness("stroke_rgb")
    low, cap, prox = config.wall_min_line_weight, config.wall_color_max_darkness, config.dimension_text_proximity
    wall = (width >= low) & ~F.coalesce("is_dashed", F.lit(False)) & (light < cap)
    thin = ~wall & (width <= config.annotation_max_line_weight)
    near = text_distance(paths.filter(thin), texts, prox)
    score = 0.5 * F.least(F.lit(1.0), (width - low) / max(low, 1e-6) + 0.5) + 0.5 * (1.0 - light / max(cap, 1e-6))
    at = F.col("near").isNotNull()
    pick = lambda a, b, c, d: F.when(wall, a).when(thin & at, b).when(thin, c).otherwise(d)
    return paths.join(grows(near), ["plan_id", "ord"], "left").withColumns({
        "candidate_type": pick(F.lit("wall_candidate"), F.lit("dimension"), F.lit("annotation"), F.lit("unknown")),
        "classification_confidence": pick(F.greatest(F.lit(0.5), F.least(F.lit(1.0), score)), F.greatest(F.lit(0.4), F.least(F.lit(0.9), 1.0 - F.col("near") / max(prox, 1e-6))), F.lit(0.7), F.lit(0.3)),
        "rule_triggered": pick(F.lit("stroke_weight_and_darkness"), F.lit("thin_stroke_near_text"), F.lit("thin_stroke_default"), F.lit("no_rule_match")),
    }).drop("near")


def rescue_by_length(classified: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """In drawings with many paths and few wall candidates, the longest solid dark lines become such."""
    plan = Window.partitionBy("plan_id")
    size = G.length("x0", "y0", "x1", "y1")
    fits = (F.col("candidate_type") != "wall_candidate") & (F.col("kind") == "line") & ~F.coalesce("is_dashed", F.lit(False)) & (G.lightness("stroke_rgb") < config.wall_color_max_darkness) & (size >= config.wall_fallback_min_length)
    rows = classified.withColumns({"__walls": F.count(F.when(F.col("candidate_type") == "wall_candidate", 1)).over(plan), "__all": F.count(F.lit(1)).over(plan), "__fits": F.coalesce(fits, F.lit(False))})
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("plan_id", "__fits").orderBy(size.desc(), "ord")))
    chosen = F.col("__fits") & (F.col("__walls") < config.wall_candidate_min_count) & (F.col("__all") > config.wall_fallback_min_paths) & (F.col("__rank") <= config.wall_fallback_max_candidates)
    return rows.withColumns({
        "candidate_type": F.when(chosen, F.lit("wall_candidate")).otherwise(F.col("candidate_type")),
        "classification_confidence": F.when(chosen, F.lit(0.4)).otherwise(F.col("classification_confidence")),
        "rule_triggered": F.when(chosen, F.lit("length_fallback_rescue")).otherwise(F.col("rule_triggered")),
    }).drop("__walls", "__all", "__fits", "__rank")


def classify_paths(paths: DataFrame, texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return rescue_by_length(classify_primary(paths, texts, config), config)


def segments(classified: DataFrame) -> DataFrame:
    """Wall candidates that are lines with a length, with angle and length; a null colour is black."""
    size = G.length("x0", "y0", "x1", "y1")
    rows = classified.filter((F.col("candidate_type") == "wall_candidate") & (F.col("kind") == "line") & (size >= 1e-9))
    return rows.select(
        "plan_id", "ord", "path_id", "x0", "y0", "x1", "y1", size.alias("length"),
        G.angle(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("angle"),
        F.coalesce("stroke_width", F.lit(0.0)).alias("stroke_width"),
        F.coalesce("stroke_rgb", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("rgb"),
        F.coalesce("is_dashed", F.lit(False)).alias("is_dashed"),
        "layer_name",
    )
