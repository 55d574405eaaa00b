"""Raw drawing commands to paths, and raw text spans to text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dash_pattern(dashes):
    """(pattern, is_dashed) of text like ``[2 2] 0``; an empty list is solid, a body that is not numbers
    is dashed without a pattern."""
    body = F.trim(F.regexp_extract(dashes, r"\[([^\]]*)\]", 1))
    parts = F.filter(F.split(body, r"\s+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    plain = dashes.isNull() | (F.trim(dashes) == "") | (body == "")
    bad = F.exists(numbers, lambda x: x.isNull())
    return F.named_struct(F.lit("pattern"), F.when(~plain & ~bad, numbers), F.lit("is_dashed"), ~plain)


def flip_y(y, page_height, flip: bool = True):
    return page_height - y if flip else y


def flip_box(box, page_height, flip: bool = True):
    """(x0, y0, x1, y1) with its order kept."""
    if not flip:
        return box
    return F.struct(box["x0"].alias("x0"), (page_height - box["y1"]).alias("y0"), box["x1"].alias("x1"), (page_height - box["y0"]).alias("y1"))


def item_segments(item):
    """The straight pieces of one drawing item: a line; a rectangle's four edges from two corners; a
    quadrilateral's four (upper left, upper right, lower right, lower left); a curve's chord, an arc.
    Other kinds have none."""
    p = lambda i: F.get(item["pts"], F.lit(i))
    piece = lambda kind, x0, y0, x1, y1: F.struct(F.lit(kind).alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    between = lambda kind, a, b: piece(kind, p(a)["x"], p(a)["y"], p(b)["x"], p(b)["y"])
    x0, y0, x1, y1 = p(0)["x"], p(0)["y"], p(1)["x"], p(1)["y"]
    rect = F.array(piece("line", x0, y0, x1, y0), piece("line", x1, y0, x1, y1), piece("line", x1, y1, x0, y1), piece("line", x0, y1, x0, y0))
    quad = F.array(between("line", 0, 1), between("line", 1, 2), between("line", 2, 3), between("line", 3, 0))
    return (
        F.when(item["kind"] == "l", F.array(between("line", 0, 1)))
        .when(item["kind"] == "re", rect)
        .when(item["kind"] == "c", F.array(piece("arc", x0, y0, p(3)["x"], p(3)["y"])))
        .when(item["kind"] == "qu", quad)
    )


def paths_of(drawings: DataFrame, flip: bool = True) -> DataFrame:
    """Paths of drawing commands, numbered in their order; widths default to 0, layers are unknown."""
    item = drawings.select("plan_id", F.col("ord").alias("d"), "color", "fill", "width", dash_pattern(F.col("dashes")).alias("dash"), "page_height", "page_num", F.posexplode("items").alias("k", "it"))
    rows = item.select("*", F.posexplode(item_segments(F.col("it"))).alias("m", "s"))
    number = (F.row_number().over(Window.partitionBy("plan_id").orderBy("d", "k", "m")) - 1).cast("int")
    y = lambda c: flip_y(F.col(f"s.{c}"), F.col("page_height"), flip)
    return rows.select(
        "plan_id", number.alias("ord"), F.concat_ws("-", F.lit("p"), "d", "k", "m").alias("path_id"), F.col("s.kind").alias("kind"),
        F.col("s.x0").alias("x0"), y("y0").alias("y0"), F.col("s.x1").alias("x1"), y("y1").alias("y1"),
        F.coalesce("width", F.lit(0.0)).alias("stroke_width"), F.col("color").alias("stroke_rgb"), F.col("fill").alias("fill_rgb"),
        F.col("dash.pattern").alias("dash_pattern"), F.col("dash.is_dashed").alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"), "page_num",
    )


def text_blocks_of(pages: DataFrame, flip: bool = True) -> DataFrame:
    """Text blocks of pages (plan_id, page_height, page_num, blocks: array of (type, lines: array of (spans:
    array of (text, bbox: array of 4)))): trimmed spans of text blocks with a whole box."""
    block = pages.select("plan_id", "page_height", "page_num", F.posexplode("blocks").alias("a", "block")).filter("block.type = 0")
    line = block.select("plan_id", "page_height", "page_num", "a", F.posexplode("block.lines").alias("b", "line"))
    span = line.select("plan_id", "page_height", "page_num", "a", "b", F.posexplode("line.spans").alias("c", "span"))
    rows = span.withColumn("text", F.trim("span.text")).filter("text <> '' AND size(span.bbox) = 4")
    box = F.struct(*[F.col("span.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    rows = rows.withColumn("box", flip_box(box, F.col("page_height"), flip))
    number = (F.row_number().over(Window.partitionBy("plan_id").orderBy("a", "b", "c")) - 1).cast("int")
    return rows.select("plan_id", number.alias("ord"), "text", *[F.col(f"box.{n}").alias(f"b{n}") for n in ("x0", "y0", "x1", "y1")], "page_num")
