"""Study intake: clip and standardise the inputs of one or many studies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import AREA_CELL_M, clip_lines, clip_polygons, points_in
from ..operators.estimates import scale_by_area


@dataclass(frozen=True)
class Study:
    area: DataFrame
    roads: DataFrame
    crashes: DataFrame
    block_groups: DataFrame
    tiles: DataFrame


def load_study(
    area: DataFrame, roads: DataFrame, crashes: DataFrame, block_groups: DataFrame, cell: float = AREA_CELL_M
) -> Study:
    """Clip standardised inputs to the study areas; all in the study's metres."""
    keyed = roads.withColumn("_row", F.struct("road_id", F.xxhash64("geom").alias("h")))
    clipped = clip_lines(keyed, area, "_row", cell).drop("_row")
    pieces = clip_polygons(block_groups, area, "geoid", cell)
    scaled = scale_by_area(block_groups.drop("rings"), pieces)
    return Study(area, clipped, points_in(crashes, area, cell), scaled, pieces)
