"""Drawings that arrive over time: each batch of new plans goes through the batch extraction, and the
documents of a plan replace those it had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..plans.extract import extract
from ..schemas import PATHS
from ..sources.sinks import write_documents


def watch(spark: SparkSession, paths_folder: str, blocks: DataFrame, plans: DataFrame, out: str, checkpoint: str, config: Config = DEFAULT):
    """A streaming query over Parquet files of paths; whole plans arrive in one file each."""
    arriving = spark.readStream.schema(PATHS).parquet(paths_folder)

    def each(batch: DataFrame, _: int) -> None:
        new = batch.select("plan_id").distinct()
        docs = extract(batch, blocks.join(new, "plan_id", "left_semi"), config).documents(plans.join(new, "plan_id", "left_semi"))
        write_documents(docs, out, "parquet")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
