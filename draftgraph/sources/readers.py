"""Tables from files: documents as JSON, marks as CSV, directories of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents of a folder, without the sidecars of dropped and of invalid ones."""
    schema = ", ".join(x for x in [DOCUMENT])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.filter(~F.col("file").contains("_dropped") & ~F.col("file").contains(".invalid"))


def marks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header; bad bytes are replaced, is_wall is 0 or 1."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("is_wall", F.col("is_wall").try_cast("int"))


def plan_files(spark: SparkSession, path: str, suffix: str = "pdf", most: int | None = None) -> DataFrame:
    """plan (file name) and content of files with the suffix in any case, by path; the first ``most``."""
    either = "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").load(path)
    rows = rows.select("path", F.col("_metadata.file_name").alias("plan"), "length", "content").orderBy("path")
    return rows.limit(most) if most is not None else rows


def labels_yaml(spark: SparkSession, paths: list[tuple[int, str]]) -> dict[str, DataFrame]:
    """Label files (plan_id, local path) as tables: rooms, missed, targets. Label files are written by
    hand, a few for each drawing, and read on the driver."""
    import yaml

    rooms, missed, targets = [], [], []
    for plan, path in paths:
        with open(path, encoding="utf-8") as f:
            doc = yaml.safe_load(f)
        if not isinstance(doc, dict):
            raise ValueError(f"{path}: the labels must be a mapping")
        for key in ("rooms", "missed_rooms"):
            if not isinstance(doc.get(key) or [], list):
                raise ValueError(f"{path}: {key} must be a list")
        for r in doc.get("rooms") or []:
            c = r.get("centroid") or [None, None]
            rooms.append((plan, r.get("room_id"), c[0], c[1], r.get("correct_type")))
        for r in doc.get("missed_rooms") or []:
            missed.append((plan, str(r.get("correct_type") if isinstance(r, dict) else r)))
        x = doc.get("cross_references") or {}
        for kind in ("detected", "valid", "missed"):
            targets += [(plan, kind, str(t)) for t in x.get(f"{kind}_targets") or []]
    return {
        "rooms": spark.createDataFrame(rooms, "plan_id long, room_id string, cx double, cy double, correct_type string"),
        "missed": spark.createDataFrame(missed, "plan_id long, correct_type string"),
        "targets": spark.createDataFrame(targets, "plan_id long, kind string, target_sheet string"),
    }
