"""Results to files: documents, sidecars, matrices and short reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(valid: DataFrame, path: str, fmt: str = "json") -> None:
    """A folder for each drawing; writing again replaces the folders of the drawings written alone."""
    out = valid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plan_id")
    out.format(fmt).save(path)


def write_invalid(invalid: DataFrame, path: str) -> int:
    """The documents that failed, with their first errors, apart from the valid ones; how many."""
    invalid.write.mode("overwrite").json(path)
    return invalid.count()


def dropped_table(**by_reason: DataFrame) -> DataFrame:
    """Dropped walls as rows with the reason: plan_id, reason, segment_id, ends, length, thickness."""
    out = None
    for reason, df in by_reason.items():
        rows = df.select("plan_id", F.lit(reason).alias("reason"), "segment_id", "x0", "y0", "x1", "y1", "length", "thickness")
        out = rows if out is None else out.unionByName(rows)
    return out


def dropped_counts(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("plan_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each class


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """A small table as Markdown; the first ``most`` rows."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def overlay_primitives(rooms: DataFrame, walls: DataFrame, junctions: DataFrame, openings: DataFrame, grid: DataFrame, entities: set[str] | None = None) -> DataFrame:
    """What a renderer draws, in its order: plan_id, layer, z, kind (polygon, line, point), xy, style."""
    point = lambda x, y: F.array(F.array(x, y))
    line = lambda d: F.array(F.array(d["x0"], d["y0"]), F.array(d["x1"], d["y1"]))
    layers = [
        ("rooms", rooms, "polygon", F.transform("ring", lambda p: F.array(p["x"], p["y"])) if rooms is not None else None, "room_type"),
        ("walls", walls, "line", line(walls) if walls is not None else None, "functional_role"),
        ("grid", grid, "line", line(grid) if grid is not None else None, "axis"),
        ("junctions", junctions, "point", point(F.col("x"), F.col("y")), "junction_type"),
        ("openings", openings, "point", point(F.col("x"), F.col("y")), "type"),
    ]
    out = None
    for z, (name, df, kind, xy, style) in enumerate(layers):
        if df is None or (entities is not None and name not in entities):
            continue
        rows = df.select("plan_id", F.lit(name).alias("layer"), F.lit(z).alias("z"), F.lit(kind).alias("kind"), xy.alias("xy"), F.col(style).alias("style"))
        out = rows if out is None else out.unionByName(rows)
    return out


def labels_yaml(rooms: DataFrame, targets: DataFrame, path: str, plan_stem: str) -> None:
    """One drawing's label template as YAML; never writes over a file."""
    import os

    import yaml

    if os.path.exists(path):
        raise FileExistsError(path)
    t = targets.first()
    doc = {
        "plan_stem": plan_stem,
        "rooms": [{"room_id": r.room_id, "centroid": [r.cx, r.cy], "area": r.area, "detected_type": r.detected_type, "correct_type": r.correct_type} for r in rooms.orderBy("room_id").collect()],
        "missed_rooms": [],
        "cross_references": {k: list(t[k]) if t else [] for k in ("detected_targets", "valid_targets", "missed_targets")},
    }
    with open(path, "x", encoding="utf-8") as f:
        yaml.safe_dump(doc, f, sort_keys=False, allow_unicode=True)
