"""Checks of documents: each gives rows (plan_id, entity, entity_id, error), so errors are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CROSS_DOCUMENT_ROLES, GRID_AXES, JUNCTION_TYPES, OPENING_TYPES, ROLES, ROOM_TYPES, TEXT_CLASSES
from ..tables import grows

IDS = {"rooms": "room_id", "walls": "segment_id", "openings": "opening_id", "text_regions": "text_region_id", "grid_lines": "grid_id", "junctions": "junction_id", "cross_references": "cross_reference_id"}
ERROR = "plan_id long, entity string, entity_id string, error string"


class InvalidDocument(ValueError):
    pass


def entity(docs: DataFrame, name: str) -> DataFrame:
    """plan_id, i, e: the records of one kind, in order."""
    return docs.select("plan_id", F.posexplode(name).alias("i", "e"))


def _is_pair(p: Column) -> Column:
    return F.coalesce((F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False))


def field_errors(name: str, e: Column) -> Column:
    """Messages for a record's fields: missing ids, values that are no member of their list, numbers out
    of range, points that are no pairs, missing lists, flags that must be set."""
    i = IDS[name]
    out: list[Column] = [F.when(F.coalesce(e[i], F.lit("")) == "", F.lit(f"{i}: must not be empty"))]

    def member(value: Column, allowed, label: str, optional: bool = False) -> None:
        bad = ~value.isin(*allowed)
        out.append(F.when(bad if optional else F.coalesce(bad, F.lit(True)), F.concat(F.lit(f"{label}: not allowed: "), F.coalesce(value, F.lit("null")))))

    def must(ok: Column, text: str) -> None:
        out.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)))

    def share(value: Column, label: str) -> None:
        must(value.between(0.0, 1.0), f"{label}: must be from 0 to 1")

    if name == "rooms":
        member(e["room_type"], ROOM_TYPES, "room_type")
        must(F.size(e["polygon"]) >= 3, "polygon: needs three points")
        out.append(F.when(F.exists(e["polygon"], lambda p: ~_is_pair(p)), F.lit("polygon: points must be pairs")))
        must(_is_pair(e["centroid"]), "centroid: must be a pair")
        must(e["area"].isNotNull(), "area: missing")
        must(e["bounding_walls"].isNotNull(), "bounding_walls: missing")
        must(e["text_labels"].isNotNull(), "text_labels: missing")
    elif name == "walls":
        g, v, t, s = e["geometry"], e["visual_properties"], e["topology"], e["semantic"]
        must(_is_pair(g["start"]), "geometry.start: must be a pair")
        must(_is_pair(g["end"]), "geometry.end: must be a pair")
        out.append(F.when(v["color_rgb"].isNotNull() & (F.size(v["color_rgb"]) != 3), F.lit("visual_properties.color_rgb: needs three numbers")))
        for side in ("start_junction_type", "end_junction_type"):
            member(t[side], JUNCTION_TYPES, f"topology.{side}", optional=True)
        must(t["connected_segment_ids"].isNotNull(), "topology.connected_segment_ids: missing")
        must(t["adjacent_room_ids"].isNotNull(), "topology.adjacent_room_ids: missing")
        member(s["functional_role"], ROLES, "semantic.functional_role")
        out.append(F.when(s["functional_role"].isin(*CROSS_DOCUMENT_ROLES) & ~F.coalesce(s["requires_cross_document_validation"], F.lit(False)), F.lit("semantic: this role needs requires_cross_document_validation")))
        share(s["confidence"], "semantic.confidence")
    elif name == "openings":
        member(e["type"], OPENING_TYPES, "type")
        must(_is_pair(e["position"]), "position: must be a pair")
        share(e["confidence"], "confidence")
    elif name == "text_regions":
        member(e["classification"], TEXT_CLASSES, "classification")
        must(F.size(e["bbox"]) == 4, "bbox: needs four numbers")
        must(e["references"].isNotNull(), "references: missing")
        must(e["linked_entity_ids"].isNotNull(), "linked_entity_ids: missing")
        must(F.length(e["rule_triggered"]) > 0, "rule_triggered: must not be empty")
        must(e["requires_cross_document_validation"].isNotNull(), "requires_cross_document_validation: missing")
        needs = (F.size(F.coalesce(e["references"], F.array().cast("array<string>"))) > 0) | (e["classification"] == "sheet_callout")
        out.append(F.when(needs & ~F.coalesce(e["requires_cross_document_validation"], F.lit(False)), F.lit("references need requires_cross_document_validation")))
    elif name == "grid_lines":
        member(e["axis"], GRID_AXES, "axis")
        must(_is_pair(e["start"]), "start: must be a pair")
        must(_is_pair(e["end"]), "end: must be a pair")
        must(F.length(e["rule_triggered"]) > 0, "rule_triggered: must not be empty")
    elif name == "junctions":
        member(e["junction_type"], JUNCTION_TYPES, "junction_type")
        must(_is_pair(e["position"]), "position: must be a pair")
        must(e["connected_segment_ids"].isNotNull(), "connected_segment_ids: missing")
    else:
        must(F.length(e["rule_triggered"]) > 0, "rule_triggered: must not be empty")
        must(e["requires_cross_document_validation"], "requires_cross_document_validation: must be set")
    return F.array_compact(F.array(*out))


def check_fields(docs: DataFrame, name: str) -> DataFrame:
    rows = entity(docs, name).select("plan_id", F.lit(name).alias("entity"), F.col("e")[IDS[name]].alias("entity_id"), F.explode(field_errors(name, F.col("e"))).alias("error"))
    return rows


def check_metadata(docs: DataFrame) -> DataFrame:
    m = F.col("metadata")
    out = [F.when(m[k].isNull(), F.lit(f"metadata.{k}: missing")) for k in ("source_pdf", "extraction_date", "pipeline_version", "coordinate_system", "page_size", "entity_counts")]
    return docs.select("plan_id", F.lit("metadata").alias("entity"), F.lit(None).cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*out))).alias("error"))


def check_unique(docs: DataFrame, name: str) -> DataFrame:
    rows = entity(docs, name).select("plan_id", F.col("e")[IDS[name]].alias("entity_id")).filter("entity_id <> ''")
    rows = rows.groupBy("plan_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.select("plan_id", F.lit(name).alias("entity"), "entity_id", F.concat(F.lit(f"{IDS[name]}: duplicate, "), F.col("n").cast("string"), F.lit(" times")).alias("error"))


#: kind, its reference (an array or one id), the kinds it may name
REFERENCES = (
    ("rooms", lambda e: e["bounding_walls"], "bounding_walls", ("walls",)),
    ("rooms", lambda e: F.filter(e["text_labels"], lambda t: t != ""), "text_labels", ("text_regions",)),
    ("walls", lambda e: F.array_compact(F.array(e["topology"]["start_junction_id"], e["topology"]["end_junction_id"])), "junction ids", ("junctions",)),
    ("walls", lambda e: e["topology"]["adjacent_room_ids"], "adjacent_room_ids", ("rooms",)),
    ("walls", lambda e: e["topology"]["connected_segment_ids"], "connected_segment_ids", ("walls",)),
    ("junctions", lambda e: e["connected_segment_ids"], "connected_segment_ids", ("walls",)),
    ("openings", lambda e: F.array_compact(F.array(e["wall_segment_id"])), "wall_segment_id", ("walls",)),
    ("openings", lambda e: e["connects_room_ids"], "connects_room_ids", ("rooms",)),
    ("text_regions", lambda e: F.array_compact(F.array(e["enclosing_room_id"])), "enclosing_room_id", ("rooms",)),
    ("text_regions", lambda e: F.filter(e["linked_entity_ids"], lambda t: t != ""), "linked_entity_ids", ("walls", "grid_lines", "rooms")),
    ("cross_references", lambda e: F.array(F.coalesce(e["source_text_region_id"], F.lit(""))), "source_text_region_id", ("text_regions",)),
)


def check_references(docs: DataFrame) -> DataFrame:
    """References to ids that are not in the same document."""
    known = reduce(DataFrame.unionAll, [entity(docs, k).select("plan_id", F.lit(k).alias("kind"), F.col("e")[v].alias("ref")) for k, v in IDS.items()]).distinct()
    rows = [entity(docs, name).select("plan_id", F.lit(name).alias("entity"), F.col("e")[IDS[name]].alias("entity_id"), F.lit(label).alias("field"), F.explode(get(F.col("e"))).alias("ref"), F.lit(",".join(kinds)).alias("kinds")) for name, get, label, kinds in REFERENCES]
    each = reduce(DataFrame.unionAll, rows).withColumn("kind", F.explode(F.split("kinds", ",")))
    found = each.join(grows(known.withColumn("ok", F.lit(True))), ["plan_id", "kind", "ref"], "left")
    bad = found.groupBy("plan_id", "entity", "entity_id", "field", "ref").agg(F.max("ok").alias("ok")).filter("ok IS NULL")
    return bad.select("plan_id", "entity", "entity_id", F.concat("field", F.lit(": unknown id "), "ref").alias("error"))


def check_counts(docs: DataFrame) -> DataFrame:
    out = [F.when(~F.col("metadata.entity_counts")[k].eqNullSafe(F.size(k).cast("long")), F.concat(F.lit(f"entity_counts.{k}: "), F.coalesce(F.col("metadata.entity_counts")[k].cast("string"), F.lit("null")), F.lit(", there are "), F.size(k).cast("string"))) for k in IDS]
    return docs.select("plan_id", F.lit("metadata").alias("entity"), F.lit(None).cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*out))).alias("error"))


def check_provenance(records: DataFrame) -> DataFrame:
    """Optional provenance (plan_id, entity, entity_id, provenance as JSON text, text_ids, wall_ids): flags
    must be booleans, lists must hold known ids."""
    p = F.col("provenance")
    out = [F.when(F.get_json_object(p, f"$.{k}").isNotNull() & ~F.get_json_object(p, f"$.{k}").isin("true", "false"), F.lit(f"provenance.{k}: must be true or false")) for k in ("rule_triggered", "requires_cross_document_validation")]
    for k, ids in (("text_provenance", "text_ids"), ("geometry_provenance", "wall_ids")):
        raw = F.get_json_object(p, f"$.{k}")
        listed = F.from_json(raw, "array<string>")
        out.append(F.when(raw.isNotNull() & ~raw.startswith("["), F.lit(f"provenance.{k}: must be a list")))
        out.append(F.when(raw.startswith("[") & (F.size(F.array_except(F.filter(listed, lambda x: x != ""), F.col(ids))) > 0), F.lit(f"provenance.{k}: unknown id")))
    return records.filter("provenance IS NOT NULL").select("plan_id", "entity", "entity_id", F.explode(F.array_compact(F.array(*out))).alias("error"))


def validate(docs: DataFrame) -> DataFrame:
    """All errors of all documents."""
    checks = [check_metadata(docs), check_counts(docs), check_references(docs)]
    for name in IDS:
        checks += [check_fields(docs, name), check_unique(docs, name)]
    return reduce(DataFrame.unionByName, checks)


def split_valid(docs: DataFrame, errors: DataFrame, preview: int = 20) -> tuple[DataFrame, DataFrame]:
    """(valid documents, invalid ones with the number of errors and the first few of them)."""
    of = errors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_errors"), F.slice(F.array_sort(F.collect_list(F.concat_ws(" ", "entity", "entity_id", "error"))), 1, preview).alias("errors"))
    return docs.join(grows(of), "plan_id", "left_anti"), docs.join(grows(of), "plan_id")


def require_valid(errors: DataFrame, preview: int = 20) -> None:
    """Raise with a preview where there are errors."""
    first = errors.limit(preview).collect()
    if first:
        raise InvalidDocument("; ".join(f"{r.plan_id} {r.entity} {r.entity_id}: {r.error}" for r in first))


def check_geometry(rooms: DataFrame) -> DataFrame:
    """Rooms (plan_id, room_id, centroid, area, polygon) whose numbers cannot be drawn: not finite, of the
    wrong arity, a negative area, a polygon of fewer than three points."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    pair = lambda p: F.coalesce((F.size(p) == 2) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))), F.lit(False))
    out = [
        F.when(~pair(F.col("centroid")), F.lit("centroid: must be two finite numbers")),
        F.when(~F.coalesce(finite(F.col("area")) & (F.col("area") >= 0), F.lit(False)), F.lit("area: must be finite and not negative")),
        F.when(F.coalesce(F.size("polygon"), F.lit(0)) < 3, F.lit("polygon: needs three points")),
        F.when(F.exists("polygon", lambda p: ~pair(p)), F.lit("polygon: points must be two finite numbers")),
    ]
    return rooms.select("plan_id", F.lit("rooms").alias("entity"), F.col("room_id").alias("entity_id"), F.explode(F.array_compact(F.array(*out))).alias("error"))
