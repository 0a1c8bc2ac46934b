"""Polygons of one key joined to outlines by cancelling the borders they share.

Every ring is drawn with its inside on the left. A border between two polygons of a key is then
drawn once each way and cancels; the edges that stay are the outline. They are chained to rings by
pointer doubling, so neither a key nor a ring is gathered before its vertices are put in their row.

Polygons of a key may share borders, parts of borders, or be repeated, but must not overlap in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import cut_lineage
from .cells import AREA_CELL_M, POINT_CELL_M, clip_polygons, edge_cells, point_cells, points_with_region
from .network import digest, line_edges
from .skew import salted_join, shuffled

SNAP_M = 1e-4
STRAIGHT_M = 1e-6
SNAP_CELL_M = 1.0

_EDGE = ["_key", "ax", "ay", "bx", "by"]


def dissolve_polygons(polygons: DataFrame, keys: list[str], snap: float = SNAP_M, size: float = AREA_CELL_M) -> DataFrame:
    """Outlines of each key's polygons: rows ``keys, part, rings, area``, one per separate part.

    ``polygons`` carries ``keys`` and ``rings``. Vertices within ``snap`` count as one, and a vertex that
    near an edge divides it. Parts that touch in points only are parts of their own; a hole that
    touches its outline or another hole in a point is a ring of its own. Outer rings run counter-clockwise,
    holes clockwise, without vertices on straight stretches. Polygons without area leave nothing; nulls in
    ``keys`` count as a value.
    """
    named = cut_lineage(polygons.select(*keys, "rings", digest(keys).alias("_key")))
    sides = _net(_snapped(cut_lineage(_ring_sides(named)), snap))
    arcs = cut_lineage(_arcs(_net(_divided(cut_lineage(sides), snap))))
    rings = cut_lineage(_rings(arcs))
    parts = _with_holes(rings, size)
    names = named.select(*keys, "_key").distinct()
    return names.join(shuffled(parts), "_key").select(*keys, "part", "rings", "area")


def clipped_outlines(polygons: DataFrame, area: DataFrame, key: str, size: float = AREA_CELL_M) -> DataFrame:
    """Polygons clipped to the area, with whole outlines instead of pieces: ``study_id, key, part, rings, area``."""
    pieces = clip_polygons(polygons, area, key, size)
    return dissolve_polygons(pieces.select("study_id", key, "rings"), ["study_id", key], size=size)


def _ring_sides(polygons: DataFrame) -> DataFrame:
    """Directed edges ``x0, y0, x1, y1`` of all rings, the inside of the polygon on their left."""
    turned = F.transform("rings", lambda r, i: F.when((g.signed_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))
    rings = polygons.select("_key", F.explode(turned).alias("_r"))
    closed = rings.select("_key", F.concat("_r", F.slice("_r", 1, 1)).alias("geom"))
    return line_edges(closed).drop("edge_no")


def _snapped(sides: DataFrame, snap: float) -> DataFrame:
    """Vertices no further apart than ``snap`` take the place of the lowest of them."""
    at = sides.select("_key", F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()

    def reach(axis):
        lo, hi = (F.floor((F.col(axis) + d) / SNAP_CELL_M) for d in (-snap, snap))
        return F.explode(F.sequence(lo, hi))

    near = at.withColumn("gx", reach("x")).withColumn("gy", reach("y")).withColumnsRenamed({"x": "ox", "y": "oy"})
    close = (F.abs(F.col("x") - F.col("ox")) <= snap) & (F.abs(F.col("y") - F.col("oy")) <= snap)
    moved = (
        salted_join(point_cells(at, SNAP_CELL_M), near, ["_key", "gx", "gy"], ["x", "y"], residual=close)
        .groupBy("_key", "x", "y")
        .agg(F.min(F.struct("ox", "oy")).alias("_to"))
        .filter((F.col("_to.ox") != F.col("x")) | (F.col("_to.oy") != F.col("y")))
    )
    moved = cut_lineage(moved)
    for x, y in (("x0", "y0"), ("x1", "y1")):
        to = moved.select("_key", F.col("x").alias(x), F.col("y").alias(y), "_to")
        sides = (
            sides.join(shuffled(to), ["_key", x, y], "left")
            .withColumn(x, F.coalesce("_to.ox", x))
            .withColumn(y, F.coalesce("_to.oy", y))
            .drop("_to")
        )
    return sides.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1"))).withColumn("n", F.lit(1))


def _net(sides: DataFrame) -> DataFrame:
    """Edges drawn one way only, from their lower end ``a`` to ``b``; ``n`` is -1 where they are drawn back.

    Edges that repeated polygons draw the same way count once.
    """
    up = F.struct("x0", "y0") < F.struct("x1", "y1")
    ends = [
        (F.when(up, F.col(p)).otherwise(F.col(q)) + 0.0).alias(out)  # + 0.0 turns -0.0 into 0.0
        for p, q, out in (("x0", "x1", "ax"), ("y0", "y1", "ay"), ("x1", "x0", "bx"), ("y1", "y0", "by"))
    ]
    signed = sides.select("_key", *ends, F.when(up, F.col("n")).otherwise(-F.col("n")).alias("n"))
    drawn = signed.groupBy(*_EDGE).agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    return drawn.filter(F.col("_hi") == F.col("_lo")).select(*_EDGE, F.col("_hi").alias("n"))


def _divided(edges: DataFrame, snap: float) -> DataFrame:
    """Edges cut where a vertex of the same key lies on them, as ``x0, y0, x1, y1, n``."""
    spots = (
        edges.select("_key", F.explode(F.array(g.point("ax", "ay"), g.point("bx", "by"))).alias("_p"))
        .select("_key", "_p.*")
        .distinct()
    )
    ends = {"ax": "x0", "ay": "y0", "bx": "x1", "by": "y1"}
    listed = edge_cells(edges.withColumnsRenamed(ends), POINT_CELL_M, snap)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    along, square = px * dx + py * dy, dx * dx + dy * dy
    on = (along > 0) & (along < square) & (F.pow(px * dy - py * dx, 2) <= snap * snap * square)
    is_end = ((px == 0) & (py == 0)) | ((F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1")))
    marks = salted_join(point_cells(spots, POINT_CELL_M), listed, ["_key", "gx", "gy"], ["x", "y"], residual=on & ~is_end)
    back = {v: k for k, v in ends.items()}
    marks = cut_lineage(marks.select("_key", *ends.values(), "n", "x", "y", (along / square).alias("_pos")).withColumnsRenamed(back))
    whole = edges.join(shuffled(marks.select(*_EDGE).distinct()), _EDGE, "left_anti").withColumnsRenamed(ends)
    first = marks.select(*_EDGE, "n", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(0.0).alias("_pos")).distinct()
    order = Window.partitionBy(*_EDGE).orderBy("_pos")
    cut = marks.unionByName(first).select(
        "_key",
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        F.coalesce(F.lead("x").over(order), "bx").alias("x1"),
        F.coalesce(F.lead("y").over(order), "by").alias("y1"),
        "n",
    )
    return whole.unionByName(cut)


def _arcs(edges: DataFrame) -> DataFrame:
    """Edges in their drawn direction, named by what they are."""
    up = F.col("n") > 0
    ends = [
        F.when(up, F.col(p)).otherwise(F.col(q)).alias(out)
        for p, q, out in (("ax", "bx", "x0"), ("ay", "by", "y0"), ("bx", "ax", "x1"), ("by", "ay", "y1"))
    ]
    drawn = edges.select("_key", *ends)
    return drawn.withColumn("arc", F.unhex(digest(["_key", "x0", "y0", "x1", "y1"])))


def _turns(arcs: DataFrame, within: str, inside: bool) -> DataFrame:
    """The arc that follows each arc at its end, among those of equal ``within``.

    With ``inside`` the two border the same corner of the inside, so that parts which touch
    come apart; else the same corner of the outside, so that touching holes do.
    """

    def at_node(here, there, out):
        angle = F.atan2(F.col(f"y{there}") - F.col(f"y{here}"), F.col(f"x{there}") - F.col(f"x{here}"))
        return arcs.select(
            within, F.col(f"x{here}").alias("x"), F.col(f"y{here}").alias("y"), angle.alias("_angle"), "arc", F.lit(out).alias("_out")
        )

    # One group is the edges at one vertex; around it arriving and leaving edges take turns.
    node = Window.partitionBy(within, "x", "y")
    order = node.orderBy(F.desc("_angle") if inside else F.asc("_angle"))
    after = F.coalesce(F.lead("arc").over(order), F.first("arc").over(order))
    around = at_node(1, 0, False).unionByName(at_node(0, 1, True))
    return around.withColumn("next", after).filter(~F.col("_out")).select("arc", "next")


def _walk(turns: DataFrame) -> DataFrame:
    """Ring of each arc (its smallest arc) and the steps ``d`` ahead to it, by pointer doubling.

    A round looks twice as far ahead as the one before. Once no arc meets a smaller one, all rings are closed.
    As every arc follows just one other, question and answer meet in a group of two: a union has one shuffle, and its
    size is estimated as a sum, where that of a join with itself would be squared in each round.
    """
    state = cut_lineage(turns.select("arc", "next", F.col("arc").alias("ring"), F.lit(0).cast("bigint").alias("d")))
    width, moved = 1, True
    while moved:
        asks = state.select(F.col("next").alias("at"), F.struct("arc", "ring", "d").alias("ask"), F.lit(None).alias("told"))
        tells = state.select(F.col("arc").alias("at"), F.lit(None).alias("ask"), F.struct("next", "ring", "d").alias("told"))
        met = asks.unionByName(tells).groupBy("at").agg(F.max("ask").alias("ask"), F.max("told").alias("told"))
        lower = F.col("told.ring") < F.col("ask.ring")
        state = cut_lineage(
            met.select(
                "ask.arc",
                "told.next",
                F.least("told.ring", "ask.ring").alias("ring"),
                F.when(lower, F.col("told.d") + width).otherwise(F.col("ask.d")).alias("d"),
                lower.alias("_moved"),
            )
        )
        moved = not state.filter("_moved").isEmpty()
        width *= 2
    return state.select("arc", "ring", "d")


def _rings(arcs: DataFrame) -> DataFrame:
    """Closed rings ``_key, ring, geom, area``; the area of holes is negative."""
    walked = arcs.join(shuffled(_walk(_turns(arcs, "_key", inside=True))), "arc")
    knotted = walked.groupBy("ring", "x0", "y0").count().filter("count > 1").select("ring").distinct()
    knotted = cut_lineage(knotted)
    if not knotted.isEmpty():
        loose = walked.join(shuffled(knotted), "ring", "left_semi")
        again = arcs.join(shuffled(_walk(_turns(loose, "ring", inside=False))), "arc")
        walked = walked.join(shuffled(knotted), "ring", "left_anti").unionByName(again.select(*walked.columns))
    # One group is the vertices of one ring, which end up in one row anyway.
    steps = F.array_sort(F.collect_list(F.struct((F.col("d") > 0).alias("later"), (-F.col("d")).alias("step"), "x0", "y0")))
    drawn = walked.groupBy("_key", "ring").agg(steps.alias("_steps"))
    ring = F.transform("_steps", lambda s: g.point(s["x0"], s["y0"]))
    plain = cut_lineage(drawn.select("_key", "ring", ring.alias("geom")))
    return (
        plain.withColumn("geom", F.explode(F.array(_corners(F.col("geom")))))
        .withColumn("area", F.explode(F.array(g.signed_area(F.col("geom")))))
        .filter(F.col("area") != 0)
    )


def _corners(ring: Column) -> Column:
    """A ring without the vertices that lie on the straight line between their neighbours."""
    n = F.size(ring)

    def bends(p, i):
        before, after = F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))
        dx, dy = after["x"] - before["x"], after["y"] - before["y"]
        cross = (p["x"] - before["x"]) * dy - (p["y"] - before["y"]) * dx
        return F.pow(cross, 2) > STRAIGHT_M * STRAIGHT_M * (dx * dx + dy * dy)

    return F.filter(ring, bends)


def _with_holes(rings: DataFrame, size: float) -> DataFrame:
    """Parts ``_key, part, rings, area``: each hole goes to the smallest outer ring around it."""
    outer, holes = rings.filter("area > 0"), rings.filter("area < 0")
    p, q = F.element_at("geom", 1), F.element_at("geom", 2)
    # The middle of an edge is on no other border, so it is inside whatever holds the hole.
    spots = holes.select(
        F.col("_key").alias("study_id"), F.col("ring").alias("hole"), ((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y")
    )
    hosts = outer.join(shuffled(holes.select("_key").distinct()), "_key", "left_semi").select(
        F.col("_key").alias("study_id"), F.struct("area", "ring").alias("host"), F.array("geom").alias("rings")
    )
    held = points_with_region(spots, hosts, "host", size, ("hole",)).groupBy("hole").agg(F.min("host").alias("_host"))
    inner = (
        holes.join(shuffled(held.select(F.col("hole").alias("ring"), F.col("_host.ring").alias("_of"))), "ring")
        .groupBy(F.col("_of").alias("ring"))
        .agg(F.sort_array(F.collect_list("geom")).alias("_holes"), F.sum("area").alias("_less"))
    )
    none = F.array().cast(g.POLYGON)
    return outer.join(shuffled(inner), "ring", "left").select(
        "_key",
        F.lower(F.hex("ring")).alias("part"),
        F.concat(F.array("geom"), F.coalesce("_holes", none)).alias("rings"),
        (F.col("area") + F.coalesce("_less", F.lit(0.0))).alias("area"),
    )
