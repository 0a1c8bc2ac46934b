"""Geometry as Column expressions.

Shapes used across the library:

* point: two DOUBLE columns ``x, y``
* line: ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``
* ring: the same array, implicitly closed
* polygon: ``ARRAY<ring>``, outer ring first; a multipolygon is several rows of one id
* half-plane: ``STRUCT<a, b, c>`` holding every point with ``a*x + b*y + c >= 0``

Everything stays in the JVM; nothing here triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def rectangle(x0, y0, x1, y1) -> Column:
    """Polygon with one ring, counter-clockwise."""
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def _rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


# ---------------------------------------------------------------- lines


def line_steps(line: Column) -> Column:
    """Consecutive vertex pairs of a line as structs ``(edge_no, x0, y0, x1, y1)``."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(line, 1, n).alias("p"), F.slice(line, 2, n).alias("q"))
    return F.transform(
        pairs,
        lambda e, i: F.struct(
            i.cast("int").alias("edge_no"),
            e["p"]["x"].alias("x0"),
            e["p"]["y"].alias("y0"),
            e["q"]["x"].alias("x1"),
            e["q"]["y"].alias("y1"),
        ),
    )


def distance(x0, y0, x1, y1) -> Column:
    dx, dy = _col(x1) - _col(x0), _col(y1) - _col(y0)
    return F.sqrt(dx * dx + dy * dy)


def line_length(line: Column) -> Column:
    return F.aggregate(
        line_steps(line),
        F.lit(0.0),
        lambda acc, e: acc + distance(e["x0"], e["y0"], e["x1"], e["y1"]),
    )


def line_substring(line: Column, m0, m1) -> Column:
    """Part of a line between two measures, as a line."""
    m0, m1 = _col(m0), _col(m1)
    zero = F.struct(F.lit(0.0).alias("m"), F.array().cast(LINE).alias("out"))

    def walk(acc, e):
        length = distance(e["x0"], e["y0"], e["x1"], e["y1"])
        lo = F.greatest(m0 - acc["m"], F.lit(0.0))
        hi = F.least(m1 - acc["m"], length)

        def at(m):
            part = F.when(length > 0, m / F.when(length > 0, length)).otherwise(F.lit(0.0))
            return point(e["x0"] + part * (e["x1"] - e["x0"]), e["y0"] + part * (e["y1"] - e["y0"]))

        start = F.when(F.size(acc["out"]) == 0, F.array(at(lo))).otherwise(acc["out"])
        grown = F.when(hi > lo, F.concat(start, F.array(at(hi)))).otherwise(acc["out"])
        return F.struct((acc["m"] + length).alias("m"), grown.alias("out"))

    return F.aggregate(line_steps(line), zero, walk, lambda acc: acc["out"])


# ---------------------------------------------------------------- point and straight edge


def project_on_edge(x, y, x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    """Parameter in [0, 1] of the point of the edge nearest to (x, y)."""
    x, y, x0, y0, x1, y1 = map(_col, (x, y, x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    len2 = dx * dx + dy * dy
    t = ((x - x0) * dx + (y - y0) * dy) / F.when(len2 > 0, len2)
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def point_segment_distance(x, y, x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    t = project_on_edge(x, y, x0, y0, x1, y1)
    x, y, x0, y0, x1, y1 = map(_col, (x, y, x0, y0, x1, y1))
    return distance(x, y, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


# ---------------------------------------------------------------- rings


def ring_edges(rings: Column) -> Column:
    """All edges of all rings as structs ``(x0, y0, x1, y1)``."""
    return F.flatten(
        F.transform(
            rings,
            lambda ring: F.zip_with(
                ring,
                _rotated(ring),
                lambda p, q: F.struct(
                    p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")
                ),
            ),
        )
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area about the first vertex, positive when counter-clockwise."""
    first = F.element_at(ring, 1)
    cross = F.zip_with(
        ring,
        _rotated(ring),
        lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"])
        - (q["x"] - first["x"]) * (p["y"] - first["y"]),
    )
    total = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2.0
    return F.when(F.size(ring) >= 3, total).otherwise(F.lit(0.0))


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less the holes, whatever their orientation."""
    return F.aggregate(
        F.transform(
            rings, lambda r, i: F.abs(signed_area(r)) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def point_in_rings(x, y, rings: Column) -> Column:
    """Even-odd test over all rings; points on an edge count as inside."""
    x, y = _col(x), _col(y)

    def crosses(e):
        spans = (e["y0"] > y) != (e["y1"] > y)
        at = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.when(spans, e["y1"] - e["y0"])
        return F.when(spans & (at > x), F.lit(1)).otherwise(F.lit(0))

    def touches(e):
        cross = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
        return (
            (cross == 0)
            & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"]))
            & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))
        )

    edges = ring_edges(rings)
    odd = F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
    return odd | F.exists(edges, touches)


def bbox(line: Column) -> Column:
    """Bounding box of a line or ring."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def moments(rings: Column) -> Column:
    """Area and first moments ``(a, mx, my)`` of a polygon; sums over parts stay exact."""

    def of_ring(ring, sign):
        first = F.element_at(ring, 1)
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
        pairs = F.zip_with(
            ring,
            _rotated(ring),
            lambda p, q: F.struct(
                (p["x"] - first["x"]).alias("px"),
                (p["y"] - first["y"]).alias("py"),
                (q["x"] - first["x"]).alias("qx"),
                (q["y"] - first["y"]).alias("qy"),
            ),
        )

        def add(acc, e):
            c = e["px"] * e["qy"] - e["qx"] * e["py"]
            return F.struct(
                (acc["a"] + c / 2.0).alias("a"),
                (acc["sx"] + c * (e["px"] + e["qx"]) / 6.0).alias("sx"),
                (acc["sy"] + c * (e["py"] + e["qy"]) / 6.0).alias("sy"),
            )

        def finish(acc):
            s = F.when(acc["a"] < 0, -sign).otherwise(sign)
            return F.struct(
                (s * acc["a"]).alias("a"),
                (s * (acc["sx"] + acc["a"] * first["x"])).alias("mx"),
                (s * (acc["sy"] + acc["a"] * first["y"])).alias("my"),
            )

        return F.aggregate(pairs, zero, add, finish)

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        F.transform(rings, lambda r, i: of_ring(r, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))),
        zero,
        lambda acc, m: F.struct(
            (acc["a"] + m["a"]).alias("a"),
            (acc["mx"] + m["mx"]).alias("mx"),
            (acc["my"] + m["my"]).alias("my"),
        ),
    )


def centroid(rings: Column) -> Column:
    m = moments(rings)
    area = F.when(m["a"] != 0, m["a"])
    return point(m["mx"] / area, m["my"] / area)


# ---------------------------------------------------------------- convex clipping


def half_plane(a, b, c) -> Column:
    return F.struct(_col(a).alias("a"), _col(b).alias("b"), _col(c).alias("c"))


def slab(axis: str, lo, hi) -> Column:
    """Half-planes of ``lo <= axis <= hi``."""
    a, b = (1.0, 0.0) if axis == "x" else (0.0, 1.0)
    return F.array(half_plane(a, b, -_col(lo)), half_plane(-a, -b, _col(hi)))


def strip_planes(x0, y0, x1, y1, width) -> Column:
    """Half-planes of the flat-capped buffer of one straight edge (a rotated rectangle)."""
    x0, y0, x1, y1, width = map(_col, (x0, y0, x1, y1, width))
    length = distance(x0, y0, x1, y1)
    ux, uy = (x1 - x0) / F.when(length > 0, length), (y1 - y0) / F.when(length > 0, length)
    along, across = x0 * ux + y0 * uy, -x0 * uy + y0 * ux
    return F.array(
        half_plane(ux, uy, -along),
        half_plane(-ux, -uy, along + length),
        half_plane(-uy, ux, width - across),
        half_plane(uy, -ux, width + across),
    )


def convex_planes(ring: Column) -> Column:
    """Half-planes of a convex ring given counter-clockwise."""
    return F.transform(
        F.filter(
            ring_edges(F.array(ring)), lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"])
        ),
        lambda e: half_plane(
            e["y0"] - e["y1"],
            e["x1"] - e["x0"],
            e["x0"] * (e["y1"] - e["y0"]) - e["y0"] * (e["x1"] - e["x0"]),
        ),
    )


def _side(plane: Column, p: Column) -> Column:
    return plane["a"] * p["x"] + plane["b"] * p["y"] + plane["c"]


def clip_ring(ring: Column, planes: Column) -> Column:
    """Part of a ring inside every half-plane (Sutherland-Hodgman)."""

    def cut(acc, plane):
        sided = F.transform(acc, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _side(plane, p).alias("s")))

        def step(p, q):
            t = p["s"] / (p["s"] - q["s"])  # reached only when the signs differ
            hit = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            end = point(q["x"], q["y"])
            return (
                F.when(p["s"] >= 0, F.when(q["s"] >= 0, F.array(end)).otherwise(F.array(hit)))
                .when(q["s"] >= 0, F.array(hit, end))
                .otherwise(F.array().cast(LINE))
            )

        return F.flatten(F.zip_with(sided, _rotated(sided), step))

    return F.aggregate(planes, ring.cast(LINE), cut)


def clip_rings(rings: Column, planes: Column) -> Column:
    """Clip every ring; rings that vanish are kept empty so the outer one stays first."""
    return F.transform(rings, lambda r: clip_ring(r, planes))


def explode_kept(rings: Column, at_least: int = 1) -> Column:
    """Generate the polygon, or no row if its outer ring has fewer vertices.

    A generator keeps Spark from evaluating a costly clip once for a filter and again
    for the result.
    """
    return F.explode(F.filter(F.array(rings), lambda r: F.size(F.element_at(r, 1)) >= at_least))


def clip_edge(planes: Column, x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    """Parameter interval ``(t0, t1)`` of an edge inside every half-plane; empty if t0 > t1."""
    p, q = point(x0, y0), point(x1, y1)
    zero = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))

    def cut(acc, plane):
        sp, sq = _side(plane, p), _side(plane, q)
        t = sp / F.when(sp != sq, sp - sq)
        return F.struct(
            F.when((sp < 0) & (sq < 0), F.lit(2.0))
            .when(sp < 0, F.greatest(acc["t0"], t))
            .otherwise(acc["t0"])
            .alias("t0"),
            F.when(sq < 0, F.least(acc["t1"], F.coalesce(t, F.lit(1.0)))).otherwise(acc["t1"]).alias("t1"),
        )

    return F.aggregate(planes, zero, cut)


def in_quad(x, y, quad: Column) -> Column:
    """Whether a point lies in a quad of :func:`trapezoids`, borders included."""
    x, y = _col(x), _col(y)
    sw, se, ne, nw = (F.get(quad, i) for i in range(4))
    t = (y - sw["y"]) / (nw["y"] - sw["y"])
    return (
        y.between(sw["y"], nw["y"])
        & (x >= sw["x"] + t * (nw["x"] - sw["x"]))
        & (x <= se["x"] + t * (ne["x"] - se["x"]))
    )


def trapezoids(rings: Column) -> Column:
    """Cut a polygon, holes included, into convex counter-clockwise quads.

    Clipping a concave ring can leave a doubled edge along the cut; it pairs up with itself
    and is dropped with the other strips of no width.
    """
    edges = F.filter(ring_edges(rings), lambda e: e["y0"] != e["y1"])
    ys = F.array_sort(
        F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["y0"], e["y1"]))))
    )
    strips = F.arrays_zip(
        F.slice(ys, 1, F.greatest(F.size(ys) - 1, F.lit(0))).alias("lo"),
        F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))).alias("hi"),
    )

    def in_strip(s):
        def at(e, y):
            t = (y - e["y0"]) / (e["y1"] - e["y0"])
            return F.when(y == e["y0"], e["x0"]).when(y == e["y1"], e["x1"]).otherwise(
                e["x0"] + t * (e["x1"] - e["x0"])
            )

        spans = F.filter(
            edges,
            lambda e: (F.least(e["y0"], e["y1"]) <= s["lo"]) & (F.greatest(e["y0"], e["y1"]) >= s["hi"]),
        )
        walls = F.array_sort(
            F.transform(
                spans,
                lambda e: F.struct(
                    ((at(e, s["lo"]) + at(e, s["hi"])) / 2.0).alias("mid"),
                    at(e, s["lo"]).alias("xlo"),
                    at(e, s["hi"]).alias("xhi"),
                ),
            )
        )
        quads = F.transform(
            walls,
            lambda w, i: F.when(
                (i % 2 == 0)
                & ((F.get(walls, i + 1)["xlo"] > w["xlo"]) | (F.get(walls, i + 1)["xhi"] > w["xhi"])),
                F.array(
                    point(w["xlo"], s["lo"]),
                    point(F.get(walls, i + 1)["xlo"], s["lo"]),
                    point(F.get(walls, i + 1)["xhi"], s["hi"]),
                    point(w["xhi"], s["hi"]),
                ),
            ),
        )
        return F.filter(quads, lambda q: q.isNotNull())

    return F.flatten(F.transform(strips, in_strip))
