"""Spatial joins as equi-joins on grid cells.

A point lies in exactly one cell. Edges and polygons are listed under every cell they can
touch, so a pair is found once per (point, edge) and an ordinary equi-join on
``(study_id, gx, gy)`` replaces a spatial index. The exact test follows as a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .skew import salted_join, shuffled

CELL = ["study_id", "gx", "gy"]
POINT_CELL_M = 100.0
AREA_CELL_M = 1000.0


def _cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / size)


def point_cells(points: DataFrame, size: float | Column, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("gx", _cell(F.col(x), size)).withColumn("gy", _cell(F.col(y), size))


def edge_cells(edges: DataFrame, size: float | Column, margin: float | Column = 0.0) -> DataFrame:
    """List each straight edge under the cells within ``margin`` of it.

    Column by column along x, then only the rows the edge reaches inside that column, so
    a long diagonal edge lists a band of cells and not its whole bounding box.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    lo, hi = F.least(x0, x1), F.greatest(x0, x1)
    out = edges.withColumn("gx", F.explode(F.sequence(_cell(lo - margin, size), _cell(hi + margin, size))))
    slope = F.coalesce((y1 - y0) / F.when(x1 != x0, x1 - x0), F.lit(0.0))
    xa = F.least(F.greatest(lo, F.col("gx") * size - margin), hi)
    xb = F.greatest(F.least(hi, (F.col("gx") + 1) * size + margin), lo)
    ya = F.when(x0 == x1, F.least(y0, y1)).otherwise(y0 + slope * (xa - x0))
    yb = F.when(x0 == x1, F.greatest(y0, y1)).otherwise(y0 + slope * (xb - x0))
    pad = margin + 1e-6
    return out.withColumn(
        "gy",
        F.explode(F.sequence(_cell(F.least(ya, yb) - pad, size), _cell(F.greatest(ya, yb) + pad, size))),
    )


def within_distance(
    edges: DataFrame,
    points: DataFrame,
    d: float | str,
    cell: float | None = None,
    salt_on: tuple[str, ...] = ("x", "y"),
) -> DataFrame:
    """Pairs of straight edge and point no further apart than ``d`` (inclusive).

    ``edges`` needs ``study_id, x0, y0, x1, y1``; ``points`` needs ``study_id, x, y``. ``d`` is a
    number or a column that both sides have with one value per study; cells then follow each
    study's own distance. Each pair comes out once with

    * ``dist``: distance,
    * ``near_m``: where along the edge the nearest point lies,
    * ``reach_lo``, ``reach_hi``: the stretch of the edge that lies within ``d``.
    """
    limit = F.col(d) if isinstance(d, str) else F.lit(float(d))
    if isinstance(d, str):
        margin, size = F.col(d), F.greatest(F.lit(cell or POINT_CELL_M), 2 * F.col(d))
    else:
        margin, size = float(d), cell or max(POINT_CELL_M, 2 * float(d))
    listed = edge_cells(edges, size, margin)
    placed = point_cells(points, size)
    if isinstance(d, str):
        placed = placed.drop(d)
    pairs = salted_join(placed, listed, CELL, list(salt_on)).drop("gx", "gy")

    length = g.distance("x0", "y0", "x1", "y1")
    near = F.col("_t") * F.col("_len")
    ux, uy = (F.col("x1") - F.col("x0")), (F.col("y1") - F.col("y0"))
    safe = F.when(F.col("_len") > 0, F.col("_len"))
    along = F.coalesce(((F.col("x") - F.col("x0")) * ux + (F.col("y") - F.col("y0")) * uy) / safe, F.lit(0.0))
    across = F.coalesce(((F.col("y") - F.col("y0")) * ux - (F.col("x") - F.col("x0")) * uy) / safe, F.lit(0.0))
    half = F.sqrt(F.greatest(limit * limit - across * across, F.lit(0.0)))
    return (
        pairs.withColumn("_t", g.project_on_edge("x", "y"))
        .withColumn(
            "dist",
            g.distance(
                F.col("x"),
                F.col("y"),
                F.col("x0") + F.col("_t") * ux,
                F.col("y0") + F.col("_t") * uy,
            ),
        )
        .filter(F.col("dist") <= limit)
        .withColumn("_len", length)
        .withColumn("near_m", near)
        .withColumn("reach_lo", F.least(F.greatest(along - half, F.lit(0.0)), near))
        .withColumn("reach_hi", F.greatest(F.least(along + half, F.col("_len")), near))
        .drop("_t", "_len")
    )


# ---------------------------------------------------------------- polygons


BORDER_M = 1e-6


def tile_polygons(polygons: DataFrame, size: float = AREA_CELL_M, margin: float = 0.0) -> DataFrame:
    """Cut each polygon along the grid: one row per polygon part and cell.

    Small local rings replace the whole boundary in every later test, so the cost per
    candidate does not grow with the size of the polygon. A small ``margin`` widens the cells,
    so that a point or line on a cell border meets the polygons on both sides of it.
    """
    box = g.bbox(F.element_at("rings", 1))

    def span(axis, cells):
        lo, hi = (F.col(f"_b.{axis}{end}") for end in ("min", "max"))
        return F.explode(F.sequence(_cell(lo - margin, size), _cell(hi + margin, size))).alias(cells)

    def clipped(axis, cells):
        planes = g.slab(axis, F.col(cells) * size - margin, (F.col(cells) + 1) * size + margin)
        return g.explode_kept(g.clip_rings(F.col("rings"), planes))

    columns = polygons.withColumn("_b", box).select("*", span("x", "gx"))
    columns = columns.withColumn("rings", clipped("x", "gx")).withColumn("_b", box)
    return columns.select("*", span("y", "gy")).drop("_b").withColumn("rings", clipped("y", "gy"))


def _contained(points: DataFrame, polygons: DataFrame, keep: list[str], size: float, salt_on, how: str) -> DataFrame:
    tiles = tile_polygons(polygons.select("study_id", *keep, "rings"), size, BORDER_M)
    quads = tiles.select(*CELL, *keep, g.trapezoids(F.col("rings")).alias("_quads"))
    inside = F.exists("_quads", lambda q: g.in_quad(F.col("x"), F.col("y"), q))
    return salted_join(point_cells(points, size), quads, CELL, list(salt_on), how, inside).drop("gx", "gy", "_quads")


def points_in(
    points: DataFrame, polygons: DataFrame, size: float = AREA_CELL_M, salt_on: tuple[str, ...] = ("x", "y")
) -> DataFrame:
    """Points inside or on the border of any polygon of their study (semi join)."""
    return _contained(points, polygons, [], size, salt_on, "left_semi")


def points_with_region(
    points: DataFrame,
    polygons: DataFrame,
    region: str,
    size: float = AREA_CELL_M,
    salt_on: tuple[str, ...] = ("x", "y"),
) -> DataFrame:
    """Every (point, region) pair where the region contains the point.

    A region of several polygons that meet at the point is listed once per polygon.
    """
    return _contained(points, polygons, [region], size, salt_on, "inner")


def clip_polygons(polygons: DataFrame, area: DataFrame, key: str, size: float = AREA_CELL_M) -> DataFrame:
    """Polygon pieces inside the area: rows ``(study_id, key, gx, gy, rings, area)``.

    The area is cut into convex quads per cell and each local ring is clipped by each
    quad, so concave areas and holes need no general overlay. The pieces of one key do not
    overlap; together they are its clipped multipolygon.
    """
    left = tile_polygons(polygons.select("study_id", key, "rings"), size)
    right = tile_polygons(area.select("study_id", F.col("rings").alias("rings")), size)
    quads = right.select(*CELL, F.explode(g.trapezoids(F.col("rings"))).alias("_quad"))
    return (
        salted_join(left, quads, CELL, [key])
        .withColumn("rings", g.explode_kept(g.clip_rings(F.col("rings"), g.convex_planes(F.col("_quad"))), 3))
        .drop("_quad")
        .withColumn("area", F.explode(F.filter(F.array(g.polygon_area(F.col("rings"))), lambda a: a > 0)))
    )


def region_of(areas: DataFrame, regions: DataFrame, region: str, size: float = AREA_CELL_M) -> DataFrame:
    """Region holding each study area's centroid, else the one it overlaps most.

    ``areas`` is ``(study_id, rings)``, ``regions`` is ``(region, rings)`` and shared by all studies.
    """
    parts = areas.groupBy("study_id").agg(
        *[F.sum(g.moments(F.col("rings"))[c]).alias(c) for c in ("a", "mx", "my")]
    )
    centres = parts.filter(F.col("a") > 0).select(
        F.lit(0).alias("study_id"),
        F.col("study_id").alias("_study"),
        (F.col("mx") / F.col("a")).alias("x"),
        (F.col("my") / F.col("a")).alias("y"),
    )
    shared = regions.select(F.lit(0).alias("study_id"), region, "rings")
    by_centre = (
        points_with_region(centres, shared, region, size, ("_study",))
        .groupBy("_study")
        .agg(F.min(region).alias("_in"))
    )
    missing = areas.join(by_centre.select(F.col("_study").alias("study_id")), "study_id", "left_anti")
    left = tile_polygons(missing.select(F.lit(0).alias("study_id"), F.col("study_id").alias("_study"), "rings"), size)
    quads = left.select(*CELL, "_study", F.explode(g.trapezoids(F.col("rings"))).alias("_quad"))
    overlap = (
        quads.join(tile_polygons(shared, size), CELL)
        .withColumn("_a", g.polygon_area(g.clip_rings(F.col("rings"), g.convex_planes(F.col("_quad")))))
        .groupBy("_study", region)
        .agg(F.sum("_a").alias("_a"))
        .filter(F.col("_a") > 0)
        .groupBy("_study")
        .agg(F.max_by(region, F.struct(F.col("_a"), F.col(region))).alias("_most"))
    )
    return (
        areas.select(F.col("study_id").alias("_study"))
        .distinct()
        .join(by_centre, "_study", "left")
        .join(overlap, "_study", "left")
        .select(F.col("_study").alias("study_id"), F.coalesce("_in", "_most").alias(region))
    )


def clip_lines(lines: DataFrame, area: DataFrame, line_id: str, size: float = AREA_CELL_M) -> DataFrame:
    """Lines cut to an area; a line leaving and re-entering gives several rows (``part``).

    ``lines`` carries ``study_id``, a key unique per row (``line_id``) and ``geom``. Pieces that only
    touch the area in a point are dropped.
    """
    steps = lines.select("study_id", line_id, F.explode(g.line_steps(F.col("geom"))).alias("e")).select(
        "study_id", line_id, "e.*"
    )
    steps = steps.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    quads = tile_polygons(area.select("study_id", "rings"), size, BORDER_M).select(
        *CELL, F.explode(g.trapezoids(F.col("rings"))).alias("_quad")
    )
    inside = (
        salted_join(edge_cells(steps, size), quads, CELL, [line_id, "edge_no"])
        .withColumn(
            "_iv",
            F.explode(F.filter(F.array(g.clip_edge(g.convex_planes(F.col("_quad")))), lambda v: v["t0"] < v["t1"])),
        )
        .select(
            "study_id",
            line_id,
            (F.col("edge_no") + F.col("_iv.t0")).alias("p0"),
            (F.col("edge_no") + F.col("_iv.t1")).alias("p1"),
        )
    )
    # One group is the pieces of one input line, so it is bounded by that row's vertices.
    along = Window.partitionBy("study_id", line_id).orderBy("p0", "p1")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        inside.withColumn("_end", F.max("p1").over(before))
        .withColumn("_new", F.when(F.col("p0") <= F.col("_end") + 1e-9, 0).otherwise(1))
        .withColumn("part", F.sum("_new").over(along).cast("int"))
        .groupBy("study_id", line_id, "part")
        .agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    )
    joined = lines.join(shuffled(islands), ["study_id", line_id])

    def at(p):
        i = F.least(F.floor(p), F.size("geom") - F.lit(2).cast("bigint")).cast("int")
        a, b = F.get("geom", i), F.get("geom", i + 1)
        t = p - i
        return g.point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))

    middle = F.filter("geom", lambda v, i: (i > F.col("p0")) & (i < F.col("p1")))
    return joined.withColumn(
        "geom", F.concat(F.array(at(F.col("p0"))), middle, F.array(at(F.col("p1"))))
    ).drop("p0", "p1")


def buffer_overlap(
    edges: DataFrame,
    tiles: DataFrame,
    keys: list[str],
    region: str,
    width: float,
    size: float = AREA_CELL_M,
    place_by: list[str] | None = None,
) -> DataFrame:
    """Area of each region inside the flat-capped buffer of straight edges.

    ``tiles`` comes from :func:`tile_polygons` or :func:`clip_polygons` with the same cell size. Each
    edge's buffer is a rotated rectangle, exact along straight stretches; at a bend it
    differs from a true buffer by the wedge between neighbours. Rows are summed per
    ``keys`` and ``region``; zero overlaps are left out. ``place_by`` (part of ``keys``) shuffles once by
    columns that a following step groups by as well.
    """
    long_enough = edges.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    listed = edge_cells(long_enough, size, width)
    strip = g.strip_planes("x0", "y0", "x1", "y1", F.lit(float(width)))
    joined = salted_join(listed, tiles.select(*CELL, region, "rings"), CELL, ["x0", "y0", "x1", "y1"])
    shares = joined.select(*keys, region, g.polygon_area(g.clip_rings(F.col("rings"), strip)).alias("_area"))
    if place_by:
        shares = shares.repartition(*place_by)
    summed = shares.groupBy(*keys, region).agg(F.sum("_area").alias("piece_area"))
    return summed.filter(F.col("piece_area") > 0)
