"""Text regions and cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as X


def text_regions(texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A classified region for each text block; nothing is dropped."""
    rows = texts.withColumns({"text": X.strip("text"), "c": X.classify("text", config), "refs": X.callouts("text", config)})
    rows = rows.withColumn("refs", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.col("refs")))
    return rows.select(
        "plan_id", "ord", F.concat(F.lit("t-"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("text_region_id"), "text",
        "bx0", "by0", "bx1", "by1", F.col("c.classification").alias("classification"), F.col("refs").alias("references"),
        F.col("c.rule").alias("rule_triggered"),
        X.needs_other_document("refs", "c.classification").alias("requires_cross_document_validation"),
    )


def cross_references(regions: DataFrame) -> DataFrame:
    """A row for each callout token of a region, in order."""
    rows = regions.select("plan_id", "ord", "text_region_id", "text", "classification", F.posexplode("references").alias("k", "target_sheet"))
    return rows.select(
        "plan_id", "ord", "k", F.concat_ws("-", F.lit("x"), F.lpad(F.col("ord").cast("string"), 6, "0"), F.col("k").cast("string")).alias("cross_reference_id"),
        F.col("text_region_id").alias("source_text_region_id"), "target_sheet", X.detail_number("text", "target_sheet").alias("target_detail"),
        F.col("classification").alias("context"), F.lit("sheet_callout_token_in_text").alias("rule_triggered"),
        F.lit(True).alias("requires_cross_document_validation"),
    )
