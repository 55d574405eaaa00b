"""Joins of near things through a grid: both sides go to the cells their boxes cover, cells are joined
by equality, and of a pair that meets in several cells the one in the cell of the larger lower
corner is kept, so no distinct is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import grows


def _cells(df: DataFrame, box: tuple[Column, Column, Column, Column], cell: float, side: str) -> DataFrame:
    low = lambda c: F.floor(c / cell)
    df = df.withColumns({f"__{side}x0": low(F.least(box[0], box[2])), f"__{side}y0": low(F.least(box[1], box[3])), f"__{side}x1": low(F.greatest(box[0], box[2])), f"__{side}y1": low(F.greatest(box[1], box[3]))})
    df = df.withColumn("__cx", F.explode(F.sequence(f"__{side}x0", f"__{side}x1")))
    return df.withColumn("__cy", F.explode(F.sequence(f"__{side}y0", f"__{side}y1"))).drop(f"__{side}x1", f"__{side}y1")


def near_join(left: DataFrame, right: DataFrame, left_box, right_box, reach: float, cell: float, condition: Column | None = None, by: str = "plan_id", left_reach: Column | None = None) -> DataFrame:
    """All pairs of ``by``-equal rows whose boxes (x0, y0, x1, y1 columns) are within ``reach`` of each
    other, or a superset of them that ``condition`` cuts down. Other columns must differ in name."""
    grow = left_reach if left_reach is not None else F.lit(reach)
    x0, y0, x1, y1 = left_box
    wide = (F.least(x0, x1) - grow, F.least(y0, y1) - grow, F.greatest(x0, x1) + grow, F.greatest(y0, y1) + grow)
    a, b = _cells(left, wide, cell, "l"), _cells(right, right_box, cell, "r")
    out = a.join(grows(b), [by, "__cx", "__cy"])
    out = out.filter((F.col("__cx") == F.greatest("__lx0", "__rx0")) & (F.col("__cy") == F.greatest("__ly0", "__ry0")))
    if condition is not None:
        out = out.filter(condition)
    return out.drop("__cx", "__cy", "__lx0", "__ly0", "__rx0", "__ry0")


def prefixed(df: DataFrame, prefix: str, keep: tuple = ("plan_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])
