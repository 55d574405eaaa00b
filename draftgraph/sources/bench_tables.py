"""Drawings derived from the test tables, by whole-number arithmetic that any engine repeats.

Paths come from ``orders``, text blocks from ``part``; ``SQL`` has the same derivations for a second
engine. Further inputs (walls, rooms, labels) are plain projections of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

WIDTHS = {"1-URGENT": 1.0, "2-HIGH": 0.75, "3-MEDIUM": 0.5, "4-NOT SPECIFIED": 0.375, "5-LOW": 0.25}
#: text of a block by its number modulo 16; {n} is part key modulo 90
TEXTS = ("A{n}", "see A30{d}/{d}", "{n}", "W-{d}", "BATHROOM", "UNIT {n}", "F{d}.", "DW", "K", "28'-{d}\"", "2{n}a", "note to builder", "KITCHEN, see E{d}.{d}", "w{d}", "", "S{d} A{d}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str, per_plan: int = 250) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    o = o.selectExpr(f"o_orderkey div {per_plan} AS plan_id", f"cast(o_orderkey % {per_plan} AS int) AS ord", "cast(o_orderkey AS string) AS path_id", "o_custkey AS c", "o_orderstatus AS s", "o_orderpriority AS p")
    o = o.selectExpr("*", "ord % 2 = 0 AS horizontal", "cast(((c * 7 + ord) % 24) * 50 + element_at(array(0, 4, 6, 10), cast((ord div 2) % 4 + 1 AS int)) AS double) AS lane", "cast((c % 10) * 50 AS double) AS a", "cast(50 * (1 + (c div 10) % 8) AS double) AS l", "(ord % 10) / 16D AS gray")
    width = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])
    return o.select(
        "plan_id", "ord", "path_id",
        F.when(F.col("ord") % 11 == 0, "arc").otherwise("line").alias("kind"),
        F.when(F.col("horizontal"), F.col("a")).otherwise(F.col("lane")).alias("x0"),
        F.when(F.col("horizontal"), F.col("lane")).otherwise(F.col("a")).alias("y0"),
        F.when(F.col("horizontal"), F.col("a") + F.col("l")).otherwise(F.col("lane")).alias("x1"),
        F.when(F.col("horizontal"), F.col("lane")).otherwise(F.col("a") + F.col("l")).alias("y1"),
        width[F.col("p")].alias("stroke_width"),
        F.array("gray", "gray", "gray").alias("stroke_rgb"),
        F.lit(None).cast("array<double>").alias("fill_rgb"),
        F.lit(None).cast("array<double>").alias("dash_pattern"),
        ((F.col("s") == "P") & (F.col("ord") % 5 == 0)).alias("is_dashed"),
        F.lit(None).cast("string").alias("layer_name"),
        F.lit(0).alias("page_num"),
    )


def text_blocks(spark: SparkSession, sf_dir: str, per_plan: int = 32) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    forms = F.array(*[F.lit(t) for t in TEXTS])
    text = F.replace(F.replace(F.get(forms, (F.col("p_partkey") % 16).cast("int")), F.lit("{n}"), (F.col("p_partkey") % 90).cast("string")), F.lit("{d}"), (F.col("p_partkey") % 9).cast("string"))
    return p.select(
        F.expr(f"p_partkey div {per_plan}").alias("plan_id"),
        (F.col("p_partkey") % per_plan).cast("int").alias("ord"),
        text.alias("text"),
        ((F.col("p_partkey") * 37) % 800).cast("double").alias("bx0"),
        ((F.col("p_partkey") * 53) % 800).cast("double").alias("by0"),
        ((F.col("p_partkey") * 37) % 800 + 20 + F.col("p_partkey") % 32).cast("double").alias("bx1"),
        ((F.col("p_partkey") * 53) % 800 + 10).cast("double").alias("by1"),
        F.lit(0).alias("page_num"),
    )


def _texts_sql() -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS)
    return f"replace(replace(([{listed}])[(p_partkey % 16 + 1)::INT], '{{n}}', (p_partkey % 90)::VARCHAR), '{{d}}', (p_partkey % 9)::VARCHAR)"


def paths_sql(per_plan: int = 250) -> str:
    widths = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WIDTHS.items())
    return f"""
o0 AS (
  SELECT o_orderkey // {per_plan} AS plan_id, (o_orderkey % {per_plan})::INT AS ord, o_orderkey::VARCHAR AS path_id,
         o_custkey AS c, o_orderstatus AS s, CASE o_orderpriority {widths} END AS stroke_width FROM orders
), o1 AS (
  SELECT *, (((c * 7 + ord) % 24) * 50 + ([0, 4, 6, 10])[((ord // 2) % 4 + 1)::INT])::DOUBLE AS lane,
         ((c % 10) * 50)::DOUBLE AS a, (50 * (1 + (c // 10) % 8))::DOUBLE AS l, (ord % 10) / 16.0::DOUBLE AS gray FROM o0
), paths AS (
  SELECT plan_id, ord, path_id, CASE WHEN ord % 11 = 0 THEN 'arc' ELSE 'line' END AS kind,
         CASE WHEN ord % 2 = 0 THEN a ELSE lane END AS x0, CASE WHEN ord % 2 = 0 THEN lane ELSE a END AS y0,
         CASE WHEN ord % 2 = 0 THEN a + l ELSE lane END AS x1, CASE WHEN ord % 2 = 0 THEN lane ELSE a + l END AS y1,
         stroke_width, gray, (s = 'P' AND ord % 5 = 0) AS is_dashed FROM o1
)"""


def texts_sql(per_plan: int = 32) -> str:
    return f"""
texts AS (
  SELECT p_partkey // {per_plan} AS plan_id, (p_partkey % {per_plan})::INT AS ord, {_texts_sql()} AS text,
         ((p_partkey * 37) % 800)::DOUBLE AS bx0, ((p_partkey * 53) % 800)::DOUBLE AS by0,
         ((p_partkey * 37) % 800 + 20 + p_partkey % 32)::DOUBLE AS bx1, ((p_partkey * 53) % 800 + 10)::DOUBLE AS by1 FROM part
)"""
