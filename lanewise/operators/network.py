"""Road stitching: edges to merged chains with measures, with no per-road collection.

A merged line is a path through nodes that exactly two edges of the same key share. Each
edge is walked in both directions; every directed edge (an "arc") knows the arc that
follows it, and pointer doubling finds its distance to the end of the path in
``log2(longest chain)`` rounds. The work of a round is spread by arc, so a chain that holds
a third of all edges costs no more per task than many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import OMIT
from ..functions import geometry as g
from ..session import cut_lineage
from .cells import edge_cells
from .skew import salted_join, shuffled

NODE_DIGITS = 6  # crossings are placed to a micrometre

NODE_CELL_M = 200.0


def line_edges(lines: DataFrame) -> DataFrame:
    """One row per straight edge: every column but ``geom``, plus ``edge_no, x0, y0, x1, y1``."""
    return (
        lines.withColumn("_e", F.explode(g.line_steps(F.col("geom"))))
        .drop("geom")
        .select("*", "_e.*")
        .drop("_e")
        .filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    )


def _undirected(edges: DataFrame) -> DataFrame:
    """Order the ends of each edge and remember whether that kept the drawn direction."""
    keeps = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    return edges.select(
        "*",
        keeps.alias("drawn_ab"),
        *[
            (F.when(keeps, F.col(p)).otherwise(F.col(q)) + 0.0).alias(out)  # + 0.0 turns -0.0 into 0.0
            for p, q, out in (("x0", "x1", "ax"), ("y0", "y1", "ay"), ("x1", "x0", "bx"), ("y1", "y0", "by"))
        ],
    ).drop("x0", "y0", "x1", "y1")


def _distinct_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeated linework; a piece drawn both ways keeps one fixed direction."""
    return pieces.groupBy(*keys, "ax", "ay", "bx", "by").agg(
        F.max(F.struct("first", "drawn_ab")).alias("_d")
    ).select(*keys, "ax", "ay", "bx", "by", "_d.first", "_d.drawn_ab")


def crossing_marks(pieces: DataFrame, keys: list[str], cell: float = NODE_CELL_M) -> DataFrame:
    """Places inside an edge where another edge of the same key crosses, meets or overlaps it."""
    ends = ["ax", "ay", "bx", "by"]
    named = pieces.withColumn("_key", digest(keys))
    listed = edge_cells(
        named.select("_key", *[F.col(a).alias(b) for a, b in zip(ends, ["x0", "y0", "x1", "y1"])]), cell, 0.0
    ).select("_key", "gx", "gy", *[F.col(b).alias(a) for a, b in zip(ends, ["x0", "y0", "x1", "y1"])])
    other = listed.select("_key", "gx", "gy", *[F.col(c).alias(f"o{c}") for c in ends])
    mine, theirs = F.struct(*ends), F.struct(*[F.col(f"o{c}").alias(c) for c in ends])
    apart = (
        (F.greatest("ax", "bx") < F.least("oax", "obx"))
        | (F.greatest("oax", "obx") < F.least("ax", "bx"))
        | (F.greatest("ay", "by") < F.least("oay", "oby"))
        | (F.greatest("oay", "oby") < F.least("ay", "by"))
    )
    pairs = salted_join(listed, other, ["_key", "gx", "gy"], ends, residual=(mine < theirs) & ~apart)

    c = {n: F.col(n) for n in [*ends, *[f"o{e}" for e in ends]]}
    rx, ry = c["bx"] - c["ax"], c["by"] - c["ay"]
    sx, sy = c["obx"] - c["oax"], c["oby"] - c["oay"]
    qx, qy = c["oax"] - c["ax"], c["oay"] - c["ay"]
    det = rx * sy - ry * sx
    t = (qx * sy - qy * sx) / F.when(det != 0, det)
    u = (qx * ry - qy * rx) / F.when(det != 0, det)
    tol = 1e-9
    meets = t.between(-tol, 1 + tol) & u.between(-tol, 1 + tol)
    # Snap to an end of either edge, or to a fixed grid, so that a junction of any edges is one and the same node.
    at = (
        F.when(F.abs(t) <= tol, g.point("ax", "ay"))
        .when(F.abs(t - 1) <= tol, g.point("bx", "by"))
        .when(F.abs(u) <= tol, g.point("oax", "oay"))
        .when(F.abs(u - 1) <= tol, g.point("obx", "oby"))
        .otherwise(g.point(F.round(c["ax"] + t * rx, NODE_DIGITS), F.round(c["ay"] + t * ry, NODE_DIGITS)))
    )
    in_line = (det == 0) & (qx * ry - qy * rx == 0)
    cuts = F.when(meets, F.array(at)).when(
        in_line, F.array(g.point("ax", "ay"), g.point("bx", "by"), g.point("oax", "oay"), g.point("obx", "oby"))
    )
    points = pairs.select("_key", mine.alias("_m"), theirs.alias("_t"), F.explode(cuts).alias("_p"))
    marks = points.select("_key", F.explode(F.array("_m", "_t")).alias("_e"), "_p").select("_key", "_e.*", "_p")
    # Position along the edge; cuts at or beyond its ends change nothing.
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    pos = ((F.col("_p.x") - F.col("ax")) * dx + (F.col("_p.y") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    is_end = F.col("_p").isin(g.point("ax", "ay"), g.point("bx", "by"))
    return marks.withColumn("_pos", pos).filter(~is_end & (F.col("_pos") > 0) & (F.col("_pos") < 1)).distinct()


def split_at_marks(pieces: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Cut the marked edges at their marks and pass the others through."""
    ends = ["ax", "ay", "bx", "by"]
    edge = ["_key", *ends]
    named = pieces.withColumn("_key", digest(keys))
    touched = named.join(shuffled(marks.select(*edge).distinct()), edge, "left_semi")
    whole = named.join(shuffled(marks.select(*edge).distinct()), edge, "left_anti")
    stops = touched.select(*edge, g.point("ax", "ay").alias("_p"), F.lit(0.0).alias("_pos")).unionByName(
        touched.select(*edge, g.point("bx", "by").alias("_p"), F.lit(1.0).alias("_pos"))
    ).unionByName(marks.select(*edge, "_p", "_pos"))
    order = Window.partitionBy(*edge).orderBy("_pos")
    spans = (
        stops.withColumn("_q", F.lead("_p").over(order))
        .withColumn("_last", F.lead("_p", 2).over(order).isNull())
        .filter(F.col("_q").isNotNull() & (F.col("_p") != F.col("_q")))
    )
    cut = (
        touched.join(shuffled(spans), edge)
        .withColumn("first", F.when(F.col("drawn_ab"), F.col("first") | (F.col("_pos") > 0)).otherwise(
            F.col("first") | ~F.col("_last")))
        .select(*keys, "_p", "_q", "first", "drawn_ab")
        .select(
            *keys, "first", "drawn_ab",
            F.col("_p.x").alias("ax"), F.col("_p.y").alias("ay"),
            F.col("_q.x").alias("bx"), F.col("_q.y").alias("by"),
        )
    )
    return whole.select(*keys, "first", "drawn_ab", *ends).unionByName(cut)


def digest(cols: list[str]) -> Column:
    """128-bit name of a tuple of columns; nulls count as a value of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in cols]
    return F.md5(F.concat_ws("\x00", *parts))


def merge_lines(edges: DataFrame, keys: list[str], node_crossings: bool = True) -> DataFrame:
    """Merge edges of equal ``keys`` into maximal lines through nodes shared by just two.

    ``edges`` needs ``keys``, ``edge_no`` and ``x0, y0, x1, y1``. The result has one row per edge, turned to
    follow its line: ``keys``, ``line_key``, ``seq``, ``x0, y0, x1, y1``, ``m0, m1`` (measures) and ``line_length``.
    A line runs the way most of the input lines in it were drawn; on a tie it starts at
    its lower-left end. A closed loop starts at a fixed node.
    """
    pieces = _distinct_pieces(
        _undirected(edges.withColumn("first", F.col("edge_no") == 0)), keys
    )
    pieces = cut_lineage(_named(pieces, keys))
    if node_crossings:
        marks = cut_lineage(crossing_marks(pieces, keys))
        if not marks.isEmpty():
            split = _distinct_pieces(split_at_marks(pieces, marks, keys), keys)
            pieces = cut_lineage(_named(split, keys))
    return _assemble(pieces, _rank(pieces, _links(pieces, keys)), keys)


def _named(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.withColumn("piece", F.unhex(digest([*keys, "ax", "ay", "bx", "by"]))).withColumn(
        "len", g.distance("ax", "ay", "bx", "by")
    )


def _links(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """For arcs that arrive at a two-edge node: the arc that follows.

    ``head`` 0 means the arc runs to the edge's ``a`` end, 1 to its ``b`` end. With two edges at a
    node, its minimum and maximum are the pair, so no self join is needed.
    """
    ends = pieces.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"), "piece", F.lit(0).alias("head"))
    ends = ends.unionByName(
        pieces.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y"), "piece", F.lit(1).alias("head"))
    )
    nodes = (
        ends.groupBy(*keys, "x", "y")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.min(F.struct("piece", "head")).alias("p"),
            F.max(F.struct("piece", "head")).alias("q"),
        )
        .filter(F.col("degree") == 2)
    )
    turns = F.array(F.struct(F.col("p").alias("i"), F.col("q").alias("o")),
                    F.struct(F.col("q").alias("i"), F.col("p").alias("o")))
    return nodes.select(F.explode(turns).alias("t")).select(
        F.col("t.i.piece").alias("piece"),
        F.col("t.i.head").alias("head"),
        F.col("t.o.piece").alias("next_piece"),
        (1 - F.col("t.o.head")).alias("next_head"),
    )


def _rank(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """Walk every arc to the end of its path.

    Gives per arc: ``len`` and ``hops`` to the end inclusive, ``votes`` (drawn along minus against)
    and the last arc with its end point.
    """
    vote = F.when(~F.col("first"), 0).when(F.col("drawn_ab"), 1).otherwise(-1)
    both = F.explode(
        F.array(
            F.struct(F.lit(0).alias("head"), (-vote).alias("votes"), F.col("ax").alias("end_x"), F.col("ay").alias("end_y")),
            F.struct(F.lit(1).alias("head"), vote.alias("votes"), F.col("bx").alias("end_x"), F.col("by").alias("end_y")),
        )
    )
    arcs = (
        pieces.select("piece", "len", both.alias("_b"))
        .select("piece", "len", "_b.*")
        .join(shuffled(links), ["piece", "head"], "left")
        .withColumn("hops", F.lit(1).cast("bigint"))
        .withColumn("votes", F.col("votes").cast("bigint"))
        .withColumn("last_piece", F.col("piece"))
        .withColumn("last_head", F.col("head"))
        .withColumn("low_piece", F.col("piece"))
        .select(*_STATE)
    )
    ranked, loops = _double(cut_lineage(arcs))
    if loops is None:
        return ranked
    # Open each closed loop at its smallest piece, at the same node in both directions.
    fresh = arcs.join(shuffled(loops), ["piece", "head"]).withColumn(
        "_open",
        ((F.col("head") == 0) & (F.col("piece") == F.col("loop")))
        | ((F.col("next_piece") == F.col("loop")) & (F.col("next_head") == 1)),
    )
    opened = fresh.select(
        *[
            F.when(F.col("_open"), F.lit(None)).otherwise(F.col(c)).alias(c) if c.startswith("next_") else F.col(c)
            for c in _STATE
        ]
    )
    again, _ = _double(cut_lineage(opened))
    return ranked.unionByName(again)


_STATE = [
    "piece", "head", "next_piece", "next_head", "len", "hops", "votes",
    "last_piece", "last_head", "end_x", "end_y", "low_piece",
]


def _double(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling until only closed loops, if any, still have a next arc.

    Arcs that have reached their end leave the rounds: they are looked up, but not written again.
    """
    open_arcs = F.count("next_piece").alias("open")
    low_sum = F.sum(F.when(F.col("next_piece").isNotNull(), F.col("_moved"))).alias("moved")
    done, going = state.filter(F.col("next_piece").isNull()), state.filter(F.col("next_piece").isNotNull())
    left = going.count()
    while left:
        ahead = done.unionByName(going).select(
            *[F.col(c).alias("_n" if c == "piece" else "_h" if c == "head" else f"n_{c}") for c in _STATE]
        )
        joined = going.join(shuffled(ahead), (F.col("next_piece") == F.col("_n")) & (F.col("next_head") == F.col("_h")))
        moved = cut_lineage(
            joined.select(
                "piece",
                "head",
                F.col("n_next_piece").alias("next_piece"),
                F.col("n_next_head").alias("next_head"),
                *[(F.col(c) + F.col(f"n_{c}")).alias(c) for c in ("len", "hops", "votes")],
                *[F.col(f"n_{c}").alias(c) for c in ("last_piece", "last_head", "end_x", "end_y")],
                F.least("low_piece", "n_low_piece").alias("low_piece"),
                (F.col("n_low_piece") < F.col("low_piece")).cast("int").alias("_moved"),
            )
        )
        now = moved.agg(open_arcs, low_sum).first()
        done = done.unionByName(moved.filter(F.col("next_piece").isNull()).select(*_STATE))
        going = moved.filter(F.col("next_piece").isNotNull()).select(*_STATE)
        if now["open"] == left and not now["moved"]:
            return done, going.select("piece", "head", F.col("low_piece").alias("loop"))
        left = now["open"]
    return done, None


def _assemble(pieces: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Orient each line and turn both distances-to-end into measures."""

    def side(head):
        return [
            F.max(F.when(F.col("head") == head, F.col(c))).alias(f"{c}{head}")
            for c in ("len", "hops", "votes", "last_piece", "end_x", "end_y")
        ]

    two = ranked.groupBy("piece").agg(*side(0), *side(1))
    c = F.col
    own = F.when(~c("first"), 0).when(c("drawn_ab"), 1).otherwise(-1)
    total = c("len1") + c("len0") - c("len")
    hops = c("hops1") + c("hops0") - 1
    # Votes of the whole line for the direction that runs this edge from a to b.
    votes_ab = c("votes1") - c("votes0") - own
    starts_low = F.struct("end_x0", "end_y0") < F.struct("end_x1", "end_y1")
    closed = (c("end_x0") == c("end_x1")) & (c("end_y0") == c("end_y1"))
    tie = F.when(closed, c("last_piece0") <= c("last_piece1")).otherwise(starts_low)
    ahead = F.when(votes_ab != 0, votes_ab > 0).otherwise(tie)
    return (
        pieces.join(shuffled(two), "piece")
        .withColumn("_fwd", ahead)
        .withColumn("_m0", F.when(c("_fwd"), total - c("len1")).otherwise(total - c("len0")))
        .select(
            *keys,
            F.lower(F.hex(F.least("last_piece0", "last_piece1"))).alias("line_key"),
            F.when(c("_fwd"), hops - c("hops1")).otherwise(hops - c("hops0")).alias("seq"),
            *[
                F.when(c("_fwd"), c(p)).otherwise(c(q)).alias(out)
                for p, q, out in (("ax", "bx", "x0"), ("ay", "by", "y0"), ("bx", "ax", "x1"), ("by", "ay", "y1"))
            ],
            c("_m0"),
            c("len"),
            total.alias("line_length"),
        )
        .withColumn("m0", F.when(c("seq") == 0, F.lit(0.0)).otherwise(c("_m0")))
        .withColumn("m1", F.least(c("m0") + c("len"), c("line_length")))
        .select(*keys, "line_key", "seq", "x0", "y0", "x1", "y1", "m0", "m1", "line_length")
    )


def dissolve_roads(roads: DataFrame, case_insensitive: bool = False, node_crossings: bool = True) -> DataFrame:
    """Stitch roads of equal name and class into linear-referenced lines, edge by edge.

    Names are compared as written and lower-cased afterwards unless ``case_insensitive``.
    Roads without a name form one group. Result: one row per edge with ``dissolved_pkey``,
    ``segment`` order ``seq``, measures ``m0, m1`` and the line's ``length_meters``.
    """
    kept = roads.filter(F.col("functional_class") != OMIT).select(
        "study_id", "road_name", "functional_class", "geom"
    )
    if case_insensitive:
        kept = kept.withColumn("road_name", F.lower("road_name"))
    merged = merge_lines(line_edges(kept), ["study_id", "road_name", "functional_class"], node_crossings)
    return (
        merged.withColumn("road_name", F.lower("road_name"))
        .withColumnRenamed("line_key", "dissolved_pkey")
        .withColumnRenamed("line_length", "length_meters")
    )


def dissolved_lines(edges: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per dissolved road, taken from its first edge (no grouping needed)."""
    return edges.filter((F.col("seq") == 0) & (F.col("length_meters") > 0)).select(
        "study_id",
        "dissolved_pkey",
        "road_name",
        "functional_class",
        F.col("x0").alias("start_x"),
        F.col("y0").alias("start_y"),
        "length_meters",
        *extra,
    )
