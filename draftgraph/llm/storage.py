"""What the corpus operators read and write through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ..tables import materialize, new_path, scratch, shared_dir

__all__ = ["materialize", "new_path", "scratch", "shared_dir", "shuffle_partitions", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; from here on the workers know this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
