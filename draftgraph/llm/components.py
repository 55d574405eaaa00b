"""Connected components of a graph of links in rounds of two joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scratch


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """Every node of ``edges`` (u, v) with the least of itself and its neighbours v."""
    return materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _round(edges: DataFrame) -> DataFrame:
    both = materialize(edges.union(edges.select("v", "u").toDF("u", "v")), "links-both")
    stars = _stars(both, "links-least")
    large = both.join(stars, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialize(large, "links-large")
    stars = _stars(large, "links-least")
    small = large.join(stars, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(small.union(stars.select("u", F.col("m").alias("v"))).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for each id in ``links`` (a, b; integers, not null): the least id that it
    reaches. Ids without a link to another are left out. Each round is written to the shared folder;
    a node's least neighbour is aggregated before the shuffle, and joins split hot nodes."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    with scratch() as keep:
        edges = materialize(links.select(u.alias("u"), v.alias("v")).filter("u > v").distinct(), "links")
        state = _state(edges)
        while state[0]:
            with scratch() as keep_round:
                edges = keep_round(_round(edges))
            old, state = state, _state(edges)
            if old == state:
                break
        keep(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
