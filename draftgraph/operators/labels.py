"""Label templates, label checks, and label merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G

TODO, WRONG = "TODO", "wrong_detection"


def template_rooms(rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rooms to label, rooms skipped because they have no id). ``rooms`` have plan_id, room_id, cx, cy,
    area, room_type, room_name, room_number."""
    has = F.coalesce("room_id", F.lit("")) != ""
    made = rooms.filter(has).select("plan_id", "room_id", F.bround("cx", 2).alias("cx"), F.bround("cy", 2).alias("cy"), F.bround("area", 1).alias("area"), F.col("room_type").alias("detected_type"), "room_name", "room_number", F.lit(TODO).alias("correct_type"))
    return made, rooms.filter(~has)


def template_targets(xrefs: DataFrame) -> DataFrame:
    """plan_id, detected_targets, valid_targets (a copy to edit), missed_targets (empty)."""
    t = xrefs.filter(F.coalesce("target_sheet", F.lit("")) != "").groupBy("plan_id").agg(F.array_sort(F.collect_set("target_sheet")).alias("detected_targets"))
    return t.select("plan_id", "detected_targets", F.col("detected_targets").alias("valid_targets"), F.array().cast("array<string>").alias("missed_targets"))


def label_errors(rooms: DataFrame, labels: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plan_id, room_id, error: rooms still to do, unknown types, repeated, stray and missing labels."""
    allowed = [*config.room_types(), WRONG]
    own = labels.select("plan_id", "room_id", F.when(F.col("room_id").isNull(), F.lit("room_id: missing")).when(F.col("correct_type").isNull(), F.lit("correct_type: missing")).when(F.col("correct_type") == TODO, F.lit("correct_type: still to do")).when(~F.col("correct_type").isin(*allowed), F.concat(F.lit("correct_type: not allowed: "), "correct_type")).alias("error")).filter("error IS NOT NULL")
    twice = labels.filter("room_id IS NOT NULL").groupBy("plan_id", "room_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("plan_id", "room_id", F.lit("room_id: labelled twice").alias("error"))
    key = ["plan_id", "room_id"]
    stray = labels.select(*key).distinct().join(rooms.select(*key), key, "left_anti").filter("room_id IS NOT NULL").withColumn("error", F.lit("room_id: no such room"))
    missing = rooms.select(*key).filter("room_id IS NOT NULL").join(labels.select(*key), key, "left_anti").withColumn("error", F.lit("room_id: no label"))
    return own.union(twice).union(stray).union(missing)


def require_labels(errors: DataFrame, preview: int = 5) -> None:
    first = errors.limit(preview).collect()
    if first:
        raise ValueError("; ".join(f"{r.plan_id} {r.room_id}: {r.error}" for r in first))


def overlay_polygon(ring, *page):
    """A ring as pixel pairs "x,y x,y" with two decimals."""
    points = F.transform(ring, lambda p: G.to_pixel(p["x"], p["y"], *page))
    return F.array_join(F.transform(points, lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"])), " ")


def drawn_room(points):
    """A room drawn by hand (array of x, y): vertices and their plain mean, to two decimals; null below
    three vertices."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y")))
    mean = lambda c: F.round(F.aggregate(rounded, F.lit(0.0), lambda s, p: s + p[c]) / F.size(rounded), 2)
    return F.when(F.size(points) >= 3, F.struct(rounded.alias("polygon"), mean("x").alias("cx"), mean("y").alias("cy"), F.lit("unknown").alias("correct_type")))


def merge_labels(current: DataFrame, loaded: DataFrame) -> DataFrame:
    """``current`` (plan_id, room_id, correct_type) with the loaded types of rooms it knows."""
    new = loaded.filter("correct_type IS NOT NULL").dropDuplicates(["plan_id", "room_id"]).select("plan_id", "room_id", F.col("correct_type").alias("__new"))
    return current.join(new, ["plan_id", "room_id"], "left").withColumn("correct_type", F.coalesce("__new", "correct_type")).drop("__new")


def progress(labels: DataFrame) -> DataFrame:
    done = F.coalesce("correct_type", F.lit(TODO)) != TODO
    return labels.groupBy("plan_id").agg(F.count(F.when(done, 1)).alias("labelled"), F.count(F.when(~done, 1)).alias("todo"))


def quoted(text):
    """A string as a quoted scalar, so that digits stay text."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
