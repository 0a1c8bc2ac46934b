"""OpenStreetMap ways and nodes to road lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import OSM_CLASS_MAP
from ..functions.geometry import point
from ..operators.skew import shuffled

HIGHWAYS = list(OSM_CLASS_MAP)
CLOSED = ["private", "no"]


def osm_roads(ways: DataFrame) -> DataFrame:
    """Drivable ways: a known highway tag, not an area, not closed to the public.

    A way without an access tag is open; only the columns needed later are kept.
    """
    tags = F.col("tags")
    area, access = F.element_at(tags, F.lit("area")), F.element_at(tags, F.lit("access"))
    kept = ways.withColumn("highway", F.element_at(tags, F.lit("highway"))).filter(
        F.col("highway").isin(HIGHWAYS)
        & (area.isNull() | (area != "yes"))
        & (access.isNull() | ~access.isin(CLOSED))
    )
    nodes = [c for c in ("node_ids", "geom") if c in ways.columns]
    return kept.select("osm_id", "highway", F.element_at(tags, F.lit("name")).alias("name"), access.alias("access"), "tags", *nodes)


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace each way's node references by coordinates, in order.

    The list rebuilt per way is the one its row held before, so it stays bounded by it.
    Ways with fewer than two known nodes are dropped.
    """
    refs = ways.select("osm_id", F.posexplode("node_ids").alias("pos", "node_id"))
    placed = refs.join(shuffled(nodes.select("node_id", "lon", "lat")), "node_id")
    geoms = placed.groupBy("osm_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", point("lon", "lat").alias("p")))).alias("_v")
    ).select("osm_id", F.transform("_v", lambda v: v["p"]).alias("geom")).filter(F.size("geom") >= 2)
    return ways.drop("node_ids").join(shuffled(geoms), "osm_id")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column, for lookups."""
    return df.select(col).distinct().orderBy(col)
