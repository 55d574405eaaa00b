"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

PATHS = "plan_id long, ord int, path_id string, kind string, x0 double, y0 double, x1 double, y1 double, stroke_width double, stroke_rgb array<double>, fill_rgb array<double>, dash_pattern array<double>, is_dashed boolean, layer_name string, page_num int"
TEXT_BLOCKS = "plan_id long, ord int, text string, bx0 double, by0 double, bx1 double, by1 double, page_num int"
FIXTURES = "plan_id long, ord int, type string, x double, y double"
DRAWINGS = "plan_id long, ord int, items array<struct<kind: string, pts: array<struct<x: double, y: double>>>>, color array<double>, fill array<double>, width double, dashes string, page_height double, page_num int"
POINT = "struct<x: double, y: double>"
WALLS_RAW = "plan_id long, ord int, segment_id string, x0 double, y0 double, x1 double, y1 double, length double, angle_degrees double, thickness double, stroke_width double, color_rgb array<double>, is_dashed boolean, layer_name string, source_path_ids array<string>, rules_passed array<string>, rules_failed array<string>, overlap_length double"
XY = "array<double>"
DOCUMENT = """plan_id long,
 metadata struct<source_pdf: string, extraction_date: string, pipeline_version: string, coordinate_system: string, page_size: array<double>, entity_counts: struct<rooms: long, walls: long, openings: long, text_regions: long, grid_lines: long, junctions: long, cross_references: long>>,
 rooms array<struct<room_id: string, polygon: array<array<double>>, area: double, centroid: array<double>, bounding_walls: array<string>, text_labels: array<string>, room_name: string, room_number: string, room_type: string, rule_triggered: string, requires_cross_document_validation: boolean>>,
 walls array<struct<segment_id: string, geometry: struct<start: array<double>, end: array<double>, centerline_length: double, angle_degrees: double, thickness: double>, visual_properties: struct<line_weight: double, color_rgb: array<double>, is_dashed: boolean, layer_name: string>, topology: struct<start_junction_id: string, end_junction_id: string, start_junction_type: string, end_junction_type: string, connected_segment_ids: array<string>, adjacent_room_ids: array<string>>, semantic: struct<functional_role: string, confidence: double, rule_triggered: string, requires_cross_document_validation: boolean>>>,
 openings array<struct<opening_id: string, type: string, position: array<double>, width: double, swing_arc: array<array<double>>, wall_segment_id: string, connects_room_ids: array<string>, confidence: double, rule_triggered: string>>,
 text_regions array<struct<text_region_id: string, text: string, bbox: array<double>, classification: string, references: array<string>, enclosing_room_id: string, linked_entity_ids: array<string>, rule_triggered: string, requires_cross_document_validation: boolean>>,
 grid_lines array<struct<grid_id: string, axis: string, label: string, start: array<double>, end: array<double>, rule_triggered: string>>,
 junctions array<struct<junction_id: string, position: array<double>, junction_type: string, connected_segment_ids: array<string>>>,
 cross_references array<struct<cross_reference_id: string, source_text_region_id: string, target_sheet: string, target_detail: string, context: string, rule_triggered: string, requires_cross_document_validation: boolean>>"""
