"""Clusters of near points, and components of pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .spatial import near_join


def near_points(points: DataFrame, order: str, radius: float) -> DataFrame:
    """plan_id, a, b: pairs of point numbers a < b within ``radius`` (x, y columns)."""
    p = points.select("plan_id", F.col(order).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    q = points.select("plan_id", F.col(order).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    box = lambda x, y: (F.col(x), F.col(y), F.col(x), F.col(y))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return near_join(p, q, box("ax", "ay"), box("bx", "by"), radius, 4 * max(radius, 0.25), (F.col("a") < F.col("b")) & (d2 <= radius * radius)).select("plan_id", "a", "b")


def cluster_points(points: DataFrame, order: str, radius: float) -> DataFrame:
    """``points`` with ``cluster``: the closure of being within ``radius``, numbered from 0 by first
    point. Clusters stay in a drawing, so each drawing is one task of a grid and a union-find."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        n = len(pdf)
        parent = list(range(n))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        if radius > 0:
            cells: dict[tuple[int, int], list[int]] = {}
            for k in range(n):
                cx, cy = int(x[k] // radius), int(y[k] // radius)
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        for m in cells.get((cx + dx, cy + dy), ()):
                            if (x[k] - x[m]) ** 2 + (y[k] - y[m]) ** 2 <= radius * radius:
                                a, b = root(k), root(m)
                                parent[max(a, b)] = min(a, b)
                cells.setdefault((cx, cy), []).append(k)
        number: dict[int, int] = {}
        pdf["cluster"] = [number.setdefault(root(k), len(number)) for k in range(n)]
        pdf["cluster"] = pdf["cluster"].astype("int32")
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", cluster int"
    return points.groupBy("plan_id").applyInPandas(run, schema)


def components(pairs: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(plan_id, node, label) for each of ``nodes`` (plan_id, node), by spreading the least label over
    ``pairs`` (plan_id, a, b) with pointer jumping; each round is written. For graphs too large
    for one task; drawings use ``cluster_points``."""
    both = materialize(pairs.select("plan_id", F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("plan_id", F.col("b").alias("node"), F.col("a").alias("other"))), "pairs")
    labels = materialize(nodes.select("plan_id", "node", F.col("node").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select("plan_id", F.col("node").alias("other"), F.col("label").alias("seen")), ["plan_id", "other"]).groupBy("plan_id", "node").agg(F.min("seen").alias("seen"))
        new = labels.join(near, ["plan_id", "node"], "left").select("plan_id", "node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        jump = new.select("plan_id", F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(new.join(jump, ["plan_id", "label"]).select("plan_id", "node", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("plan_id", "node", "label")
        if not changed:
            return labels
    raise RuntimeError("the labels did not settle")
