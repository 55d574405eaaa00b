"""Thresholds and word lists of the extraction, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Patterns, labels and thresholds that results depend on.
ROOM_TYPES = ("unit", "bathroom", "kitchen", "bedroom", "living_room", "dining_room", "closet", "entry", "garage", "stair", "hallway", "mechanical", "laundry", "storage", "office", "unknown")
ROOM_PATTERNS = (
    ("bathroom", ("BATH", "WC", "RESTROOM", "POWDER", "TOILET", "LAVATORY")),
    ("kitchen", ("KITCHEN", "KITCHENETTE", "KIT")),
    ("bedroom", ("BEDROOM", "BDRM", "MASTER BED", "MSTR BED")),
    ("living_room", ("LIVING ROOM", "LIVING RM", "LIV ROOM", "FAMILY ROOM", "GREAT ROOM")),
    ("dining_room", ("DINING ROOM", "DINING RM", "DINING")),
    ("closet", ("CLOSET", "CLST", "WALK-IN")),
    ("entry", ("ENTRY", "FOYER", "VESTIBULE", "LOBBY")),
    ("garage", ("GARAGE",)),
    ("stair", ("STAIR", "STAIRS", "EXIT STAIR")),
    ("hallway", ("HALL", "HALLWAY", "CORRIDOR")),
    ("mechanical", ("MECH", "MECHANICAL", "ELEC", "ELECTRICAL", "DATA", "IT", "UTILITY")),
    ("unit", ("UNIT", "APARTMENT", "APT", "STUDIO", "1-BR", "2-BR", "3-BR", "4-BR", "5-BR", "1BR", "2BR", "3BR", "4BR", "5BR")),
    ("laundry", ("LAUNDRY", "WASH")),
    ("storage", ("STORAGE", "STOR")),
    ("office", ("OFFICE", "CONFERENCE", "MEETING")),
)
FIXTURE_ROOMS = (
    ("bathroom", ("toilet", "sink")),
    ("kitchen", ("stove", "range", "cooktop")),
    ("laundry", ("washer", "dryer", "laundry")),
    ("mechanical", ("hvac", "furnace", "boiler")),
)
WET_LABELS = ("BATH", "BATHROOM", "KITCHEN", "WC", "RESTROOM", "POWDER", "KITCHENETTE")
WET_ROOMS = ("bathroom", "kitchen", "laundry")
GRID_BLOCKLIST = ("DW", "DN", "UP", "W", "D", "REF", "WC", "WD", "DR", "TV", "AC", "EQ", "FD", "FX")
ROOM_NUMBER = r"^[0-9]{2,4}[a-zA-Z]?$"
SHEET_CALLOUT = r"^[A-Z][0-9]+[.]?[0-9]*[a-z]?$"
DIMENSION = r"^[0-9]+['\"\-\s/0-9]+$"
GRID_LABEL = r"^[A-Z]{1,2}$|^[0-9]{1,2}$|^[A-Z][.][0-9]+$"
WALL_TAG = r"^[WCSwcs][-]?[0-9]{1,3}[a-z]?$"
PLAUSIBLE_SHEET = r"^[A-Z][A-Z\-]?\d+(\.\d+[a-z]?)?$"
FIXTURE_CALLOUT = r"^[A-Z]\d+\.$"
SHORT_TAG = r"^[A-Z]\d$"
ROLES = ("exterior", "demising", "interior_partition", "wet_wall", "bearing_wall", "unknown")
CROSS_DOCUMENT_ROLES = ("bearing_wall", "wet_wall")
JUNCTION_TYPES = ("corner", "t-junction", "x-junction", "endpoint")
OPENING_TYPES = ("door", "window", "unknown")
TEXT_CLASSES = ("room_label", "room_number", "sheet_callout", "dimension", "wall_schedule_tag", "note", "title", "grid_label", "unknown")
GRID_AXES = ("horizontal", "vertical")
VERSION = "0.6.0"
COORDINATES = "pdf_points_bottom_left_origin"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    coordinate_flip_y: bool = True
    wall_min_line_weight: float = 0.5
    annotation_max_line_weight: float = 0.3
    dimension_text_proximity: float = 15.0
    wall_color_max_darkness: float = 0.3
    wall_candidate_min_count: int = 100
    wall_fallback_min_paths: int = 500
    wall_fallback_min_length: float = 20.0
    wall_fallback_max_candidates: int = 1500
    parallel_angle_tolerance: float = 2.0
    orthogonal_angle_tolerance: float = 5.0
    wall_min_thickness: float = 2.0
    wall_max_thickness: float = 40.0
    wall_min_overlap_ratio: float = 0.3
    thickness_cluster_bin_width: float = 0.3
    thickness_cluster_min_support: int = 3
    thickness_cluster_tolerance: float = 0.25
    thickness_cluster_max_modes: int = 3
    thickness_cluster_mode_max_realistic: float = 18.0
    thickness_cluster_min_candidates: int = 10
    junction_snap_distance: float = 3.0
    isolated_max_length: float = 30.0
    gap_close_distance: float = 0.0
    gap_close_max_angle_drift: float = 15.0
    junction_anchor_enabled: bool = False
    junction_anchor_tag_only: bool = True
    junction_anchor_min_cluster_size: int = 3
    junction_anchor_snap_tolerance: float = 15.0
    junction_raw_snap_radius: float = 3.0
    junction_anchor_min_segments: int = 20
    demising_min_length: float = 200.0
    semantic_min_confidence: float = 0.4
    wet_zone_proximity: float = 50.0
    bearing_min_continuous_length: float = 300.0
    exterior_tolerance: float = 9.0
    evaluation_match_proximity: float = 3.0
    room_min_area: float = 500.0
    room_boundary_tolerance: float = 9.0
    room_max_aspect_ratio: float = 5.0
    room_min_short_dimension: float = 15.0
    room_gap_close_enabled: bool = True
    room_gap_close_max_distance: float = 60.0
    room_gap_close_max_angle_drift_deg: float = 20.0
    door_arc_span_min_deg: float = 60.0
    door_arc_span_max_deg: float = 120.0
    door_arc_chord_min: float = 10.0
    door_arc_chord_max: float = 200.0
    door_to_wall_distance: float = 15.0
    grid_line_min_length: float = 300.0
    grid_label_proximity: float = 40.0
    grid_endpoint_near_boundary: float = 50.0
    grid_line_axis_tolerance_deg: float = 5.0
    benchmark_per_plan_timeout_s: float = 300.0
    wet_zone_labels: tuple = WET_LABELS
    allowed_room_types: tuple = ROOM_TYPES
    room_type_label_patterns: tuple = ROOM_PATTERNS
    text_room_number_pattern: str = ROOM_NUMBER
    text_sheet_callout_pattern: str = SHEET_CALLOUT
    text_dimension_pattern: str = DIMENSION
    text_grid_label_pattern: str = GRID_LABEL
    text_grid_label_blocklist: tuple = GRID_BLOCKLIST

    @classmethod
    def from_mapping(cls, values: object, require_all: bool = False) -> Config:
        if not isinstance(values, dict):
            raise ConfigError("the configuration must be a mapping")
        names = {f.name for f in fields(cls)}
        if require_all and (missing := sorted(names - set(values))):
            raise ConfigError(f"missing keys: {', '.join(missing)}")
        found = {}
        for k, v in values.items():
            if k in names:
                if k == "room_type_label_patterns" and isinstance(v, dict):
                    v = tuple((room, tuple(words)) for room, words in v.items())
                found[k] = tuple(v) if isinstance(v, list) else v
        return cls(**found)

    @classmethod
    def from_yaml(cls, path: str, require_all: bool = True) -> Config:
        import os

        import yaml

        if not os.path.exists(path):
            raise ConfigError(f"no such file: {path}")
        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f), require_all)

    def room_types(self) -> tuple:
        """The allowed room types, in order; an error where they are no list of names."""
        if not isinstance(self.allowed_room_types, tuple) or not self.allowed_room_types:
            raise ConfigError("allowed_room_types must be a list that is not empty")
        return self.allowed_room_types


DEFAULT = Config()
