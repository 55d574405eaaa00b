"""The nested document of each drawing, from its entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COORDINATES, VERSION
from ..functions import geometry as G
from ..tables import grows

ENTITIES = ("rooms", "walls", "openings", "text_regions", "grid_lines", "junctions", "cross_references")


def wall_record():
    """A wall's nested record; length and angle come from its ends, missing values get defaults."""
    size = G.length("x0", "y0", "x1", "y1")
    no_ids = F.array().cast("array<string>")
    return F.struct(
        F.col("segment_id"),
        F.struct(F.array("x0", "y0").alias("start"), F.array("x1", "y1").alias("end"), size.alias("centerline_length"), G.angle(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("angle_degrees"), F.coalesce("thickness", F.lit(0.0)).alias("thickness")).alias("geometry"),
        F.struct(F.coalesce("stroke_width", F.lit(0.0)).alias("line_weight"), F.coalesce("color_rgb", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("color_rgb"), F.coalesce("is_dashed", F.lit(False)).alias("is_dashed"), F.col("layer_name")).alias("visual_properties"),
        F.struct("start_junction_id", "end_junction_id", "start_junction_type", "end_junction_type", F.coalesce("connected_segment_ids", no_ids).alias("connected_segment_ids"), F.coalesce("adjacent_room_ids", no_ids).alias("adjacent_room_ids")).alias("topology"),
        F.struct(F.coalesce("functional_role", F.lit("unknown")).alias("functional_role"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "rule_triggered", F.coalesce("requires_cross_document_validation", F.lit(False)).alias("requires_cross_document_validation")).alias("semantic"),
    )


def _listed(df: DataFrame, name: str, order, record) -> DataFrame:
    """plan_id and the records in order."""
    rows = df.select("plan_id", F.struct(order.alias("o"), record.alias("r")).alias("s"))
    return rows.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]).alias(name))


def public(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def assemble(plans: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame, regions: DataFrame, grid: DataFrame, junctions: DataFrame, xrefs: DataFrame) -> DataFrame:
    """One row for each of ``plans`` (plan_id, source_pdf, width, height): the document. ``regions`` have
    enclosing_room_id and linked_entity_ids, ``walls`` adjacent_room_ids."""
    labels = regions.filter("enclosing_room_id IS NOT NULL").groupBy("plan_id", F.col("enclosing_room_id").alias("room_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text_region_id"))), lambda s: s["text_region_id"]).alias("text_labels"))
    rooms = rooms.join(grows(labels), ["plan_id", "room_id"], "left")
    none = F.array().cast("array<string>")
    pair = lambda p: F.array(p["x"], p["y"])
    parts = [
        _listed(rooms, "rooms", F.col("room"), F.struct("room_id", F.transform("ring", pair).alias("polygon"), "area", F.array("cx", "cy").alias("centroid"), "bounding_walls", F.coalesce("text_labels", none).alias("text_labels"), "room_name", "room_number", "room_type", "rule_triggered", "requires_cross_document_validation")),
        _listed(walls, "walls", F.col("segment_id"), wall_record()),
        _listed(openings, "openings", F.col("ord"), F.struct("opening_id", "type", F.array("x", "y").alias("position"), "width", "swing_arc", "wall_segment_id", "connects_room_ids", "confidence", "rule_triggered")),
        _listed(regions, "text_regions", F.col("ord"), F.struct("text_region_id", "text", F.array("bx0", "by0", "bx1", "by1").alias("bbox"), "classification", "references", "enclosing_room_id", F.coalesce("linked_entity_ids", none).alias("linked_entity_ids"), "rule_triggered", "requires_cross_document_validation")),
        _listed(grid, "grid_lines", F.col("ord"), F.struct("grid_id", "axis", "label", F.array("x0", "y0").alias("start"), F.array("x1", "y1").alias("end"), "rule_triggered")),
        _listed(junctions, "junctions", F.col("junction_id"), F.struct("junction_id", F.array("x", "y").alias("position"), "junction_type", "connected_segment_ids")),
        _listed(xrefs, "cross_references", F.struct("ord", "k"), F.struct("cross_reference_id", "source_text_region_id", "target_sheet", "target_detail", "context", "rule_triggered", "requires_cross_document_validation")),
    ]
    doc = plans.select("plan_id", "source_pdf", "width", "height")
    for p in parts:
        doc = doc.join(grows(p), "plan_id", "left")
    kinds = {name: dict(p.dtypes)[name] for name, p in zip(ENTITIES, parts)}
    doc = doc.withColumns({k: F.coalesce(k, F.array().cast(t)) for k, t in kinds.items()})
    counts = F.struct(*[F.size(k).cast("long").alias(k) for k in ENTITIES])
    meta = F.struct("source_pdf", F.date_format(F.current_date(), "yyyy-MM-dd").alias("extraction_date"), F.lit(VERSION).alias("pipeline_version"), F.lit(COORDINATES).alias("coordinate_system"), F.array("width", "height").alias("page_size"), counts.alias("entity_counts"))
    return doc.select("plan_id", meta.alias("metadata"), *ENTITIES)
