"""The whole extraction over all drawings at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import assemble, classify, grid, openings, roles, rooms, texts, topology, validate, walls
from ..shipping import ship
from ..tables import grows, materialize


@dataclass
class Extraction:
    paths: DataFrame
    walls: DataFrame
    junctions: DataFrame
    rooms: DataFrame
    openings: DataFrame
    regions: DataFrame
    grid: DataFrame
    xrefs: DataFrame
    dropped_by_thickness: DataFrame
    dropped_by_isolation: DataFrame

    def documents(self, plans: DataFrame) -> DataFrame:
        return assemble.assemble(plans, self.rooms, self.walls, self.openings, self.regions, self.grid, self.junctions, self.xrefs)


def extract(paths: DataFrame, blocks: DataFrame, config: Config = DEFAULT, fixtures: DataFrame | None = None) -> Extraction:
    """Entities of all drawings of ``paths`` and text ``blocks``. Tables that many later steps read are
    written once in the shared folder."""
    ship(paths.sparkSession)
    cut = lambda df: materialize(df, "entities")
    classified = classify.classify_paths(paths, blocks, config)
    raw, by_thickness = walls.detect_walls(classified, config)
    made, junctions, by_isolation = topology.build_topology(cut(raw), config)
    made, junctions = topology.merge_gaps(cut(made), cut(junctions), config)
    regions = cut(texts.text_regions(blocks, config))
    xrefs = texts.cross_references(regions)
    found, adjacency = rooms.detect_rooms(made, junctions, blocks, config, fixtures)
    found, adjacency = cut(found), cut(adjacency)
    doors = cut(openings.detect_openings(paths, made, adjacency, config))
    lines, links = (cut(x) for x in grid.detect_grid(paths, regions, config))
    ruled = roles.assign_roles(made, blocks, found, adjacency, config).join(grows(adjacency), ["plan_id", "segment_id"], "left")
    ruled = cut(ruled)  # the plan of the documents would hold those of all entities
    linked = links.groupBy("plan_id", F.col("l_ord").alias("ord")).agg(F.array_sort(F.collect_set("grid_id")).alias("linked_entity_ids"))
    regions = regions.join(grows(rooms.enclosing_rooms(regions, found)), ["plan_id", "text_region_id"], "left").join(grows(linked), ["plan_id", "ord"], "left")
    regions = cut(regions)
    return Extraction(paths, ruled, junctions, found, doors, regions, lines, xrefs, by_thickness, by_isolation)


def run(paths: DataFrame, blocks: DataFrame, plans: DataFrame, config: Config = DEFAULT, fixtures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of all drawings."""
    docs = materialize(extract(paths, blocks, config, fixtures).documents(plans), "documents")
    return docs, validate.validate(docs)
