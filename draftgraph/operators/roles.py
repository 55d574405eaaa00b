"""Functional roles of walls: rules in order, each on what the rules before left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CROSS_DOCUMENT_ROLES, DEFAULT, WET_ROOMS, Config
from ..functions import geometry as G
from ..functions import text as X
from ..tables import grows
from . import polygons
from .spatial import near_join

THROUGH = ("t-junction", "x-junction")


def hulls(walls: DataFrame) -> DataFrame:
    """plan_id, ring: the closed convex hull of all walls' ends; none where they lie in line."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = list(zip(pdf.x0, pdf.y0)) + list(zip(pdf.x1, pdf.y1))
        h = polygons.hull([(float(x), float(y)) for x, y in points])
        rows = [(pdf.plan_id.iloc[0], [{"x": x, "y": y} for x, y in [*h, h[0]]])] if len(h) > 2 else []
        return pd.DataFrame(rows, columns=["plan_id", "ring"])

    ends = walls.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1"))).select("plan_id", "x0", "y0", "x1", "y1")
    return ends.groupBy("plan_id").applyInPandas(run, "plan_id long, ring array<struct<x: double, y: double>>")


def exterior(walls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, segment_id of walls whose middle is near the hull's ring."""
    rows = walls.join(grows(hulls(walls)), "plan_id")
    near = G.ring_distance("ring", G.midpoint("x0", "x1"), G.midpoint("y0", "y1")) <= config.exterior_tolerance
    return rows.filter(near).select("plan_id", "segment_id")


def is_demising(config: Config = DEFAULT):
    return (F.col("length") > config.demising_min_length) & F.col("start_junction_type").isin(*THROUGH) & F.col("end_junction_type").isin(*THROUGH)


def wet_by_room(walls: DataFrame, adjacency: DataFrame, rooms: DataFrame) -> DataFrame:
    """plan_id, segment_id of walls beside a bathroom, kitchen or laundry."""
    wet = rooms.filter(F.col("room_type").isin(*WET_ROOMS)).select("plan_id", "room_id")
    beside = adjacency.select("plan_id", "segment_id", F.explode("adjacent_room_ids").alias("room_id"))
    return walls.select("plan_id", "segment_id").join(grows(beside.join(grows(wet), ["plan_id", "room_id"], "left_semi")), ["plan_id", "segment_id"], "left_semi")


def wet_by_label(walls: DataFrame, texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, segment_id of walls whose middle is in the widened box of a wet room's label."""
    norm = X.letters("text")
    starts = F.lit(False)
    for label in config.wet_zone_labels:
        starts = starts | norm.startswith(label.upper())
    p = config.wet_zone_proximity
    zones = texts.filter(starts).select("plan_id", *[(F.col(c) + d).alias(f"z{c}") for c, d in (("bx0", -p), ("by0", -p), ("bx1", p), ("by1", p))])
    mids = walls.select("plan_id", "segment_id", G.midpoint("x0", "x1").alias("mx"), G.midpoint("y0", "y1").alias("my"))
    inside = F.col("mx").between(F.col("zbx0"), F.col("zbx1")) & F.col("my").between(F.col("zby0"), F.col("zby1"))
    pairs = near_join(mids, zones, tuple(F.col(c) for c in ("mx", "my", "mx", "my")), tuple(F.col(c) for c in ("zbx0", "zby0", "zbx1", "zby1")), 0.0, 256.0, inside)
    return pairs.select("plan_id", "segment_id").distinct()


def bearing_chains(eligible: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, segment_id of walls on long chains. Seeds go longest first; a chain runs on at its end, then
    at its start, through corners and crossings, always along the longest free wall; walls of short
    chains stay free. Each step depends on the ones before, so a drawing is one task."""
    least = config.bearing_min_continuous_length

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        size, sc, ec = pdf.length.tolist(), pdf.sc.tolist(), pdf.ec.tolist()
        kind = dict(zip(sc, pdf.start_junction_type)) | dict(zip(ec, pdf.end_junction_type))
        at: dict[int, list[int]] = {}
        for k, (s, e) in enumerate(zip(sc, ec)):
            at.setdefault(s, []).append(k)
            if e != s:
                at.setdefault(e, []).append(k)
        taken: set[int] = set()
        for seed in sorted(range(len(size)), key=lambda k: -size[k]):
            if seed in taken:
                continue
            chain = [seed]
            held = {seed}
            for node in (ec[seed], sc[seed]):
                while kind.get(node) in ("corner", *THROUGH):
                    free = [k for k in at[node] if k not in held and k not in taken]
                    if not free:
                        break
                    k = max(free, key=lambda i: (size[i], -i))
                    chain.append(k)
                    held.add(k)
                    node = ec[k] if sc[k] == node else sc[k]
            if len(chain) > 1 and sum(size[k] for k in chain) > least:
                taken |= held
        return pdf.loc[sorted(taken), ["plan_id", "segment_id"]]

    cols = ["plan_id", "ord", "segment_id", "length", "sc", "ec", "start_junction_type", "end_junction_type"]
    return eligible.select(*cols).groupBy("plan_id").applyInPandas(run, "plan_id long, segment_id string")


def with_role(walls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From ``asked``, ``confidence`` and ``rule`` to the role that counts: below the least confidence a
    role other than exterior is unknown."""
    weak = (F.col("confidence") < config.semantic_min_confidence) & (F.col("asked") != "exterior")
    return walls.withColumns({
        "functional_role": F.when(weak, F.lit("unknown")).otherwise(F.col("asked")),
        "rule_triggered": F.when(weak, F.concat("rule", F.lit("_low_confidence"))).otherwise(F.col("rule")),
        "requires_cross_document_validation": F.col("asked").isin(*CROSS_DOCUMENT_ROLES),
    }).drop("asked", "rule")


def assign_roles(walls: DataFrame, texts: DataFrame, rooms: DataFrame, adjacency: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``walls`` with functional_role, confidence, rule_triggered, requires_cross_document_validation."""
    flag = lambda df, name: df.select("plan_id", "segment_id", F.lit(True).alias(name)).distinct()
    key = ["plan_id", "segment_id"]
    rows = walls.join(grows(flag(exterior(walls, config), "is_ext")), key, "left").join(grows(flag(wet_by_room(walls, adjacency, rooms), "is_room")), key, "left").join(grows(flag(wet_by_label(walls, texts, config), "is_label")), key, "left")
    rows = rows.withColumn("is_dem", is_demising(config))
    first = (
        F.when(F.col("is_ext"), F.lit("exterior")).when(F.col("is_dem"), F.lit("demising"))
        .when(F.col("is_room"), F.lit("wet_room")).when(F.col("is_label"), F.lit("wet_label"))
    )
    rows = rows.withColumn("first", first)
    bearing = flag(bearing_chains(rows.filter("first IS NULL"), config), "is_bear")
    rows = rows.join(grows(bearing), key, "left").withColumn("first", F.coalesce("first", F.when(F.col("is_bear"), F.lit("bearing")), F.lit("interior")))
    table = {
        "exterior": ("exterior", 0.9, "exterior_convex_hull"), "demising": ("demising", 0.7, "demising_long_through"),
        "wet_room": ("wet_wall", 0.7, "wet_wall_bounds_wet_room"), "wet_label": ("wet_wall", 0.5, "wet_wall_text_label_proximity"),
        "bearing": ("bearing_wall", 0.4, "bearing_continuous_path"), "interior": ("interior_partition", 0.6, "default_interior"),
    }
    pick = lambda k: F.create_map(*[F.lit(x) for name, row in table.items() for x in (name, row[k])])[F.col("first")]
    rows = rows.withColumns({"asked": pick(0), "confidence": pick(1), "rule": pick(2)})
    return with_role(rows.drop("is_ext", "is_room", "is_label", "is_dem", "is_bear", "first"), config)
