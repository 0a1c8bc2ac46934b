"""Queries over clipping, regions, projection and geometry expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import geometry as g
from lanewise.functions import projection as p
from lanewise.operators import cells, estimates, outlines
from lanewise.plans import intake
from lanewise.sources import features

from . import fixtures as fx
from .registry import query


def _r(col, digits=6):
    return F.round(F.col(col), digits).alias(col)


BASE = fx.cte("fx_roads", "fx_crashes", "fx_area", "fx_block_groups")


@query(
    "points_in_area",
    f"WITH {BASE} SELECT crash_id FROM fx_crashes, fx_area WHERE x BETWEEN ax0 AND ax1 AND y BETWEEN ay0 AND ay1",
)
def points_in_area(spark, sf):
    return cells.points_in(fx.crashes(spark, sf), fx.area(spark, sf)).select("crash_id")


@query(
    "points_by_block_group",
    f"""WITH {BASE} SELECT geoid, count(*) AS crashes FROM fx_crashes JOIN fx_block_groups
      ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 GROUP BY geoid""",
)
def points_by_block_group(spark, sf):
    """A crash on a shared border belongs to every block group it touches."""
    pairs = cells.points_with_region(fx.crashes(spark, sf), fx.block_groups(spark, sf), "geoid", salt_on=("crash_id",))
    return pairs.groupBy("geoid").agg(F.count(F.lit(1)).alias("crashes"))


CLIPPED = """clipped AS (
  SELECT road_id, greatest(x0, ax0) AS cx0, least(x1, ax1) AS cx1, y0 AS cy FROM fx_roads, fx_area
  WHERE x1 > ax0 AND x0 < ax1 AND y0 BETWEEN ay0 AND ay1)"""


@query("clip_roads", f"WITH {BASE}, {CLIPPED} SELECT road_id, round(cx0, 6) AS cx0, round(cx1, 6) AS cx1, cy FROM clipped")
def clip_roads(spark, sf):
    c = cells.clip_lines(fx.roads(spark, sf), fx.area(spark, sf), "road_id")
    return c.select(
        "road_id", F.round(F.element_at("geom", 1)["x"], 6).alias("cx0"),
        F.round(F.element_at("geom", -1)["x"], 6).alias("cx1"), F.element_at("geom", 1)["y"].alias("cy"),
    )


_SHARE = """(least(bx1, ax1) - greatest(bx0, ax0)) * (least(by1, ay1) - greatest(by0, ay0))"""


@query(
    "clip_block_groups",
    f"""WITH {BASE} SELECT geoid, round({_SHARE}, 3) AS area FROM fx_block_groups, fx_area
      WHERE bx1 > ax0 AND bx0 < ax1 AND by1 > ay0 AND by0 < ay1""",
)
def clip_block_groups(spark, sf):
    c = cells.clip_polygons(fx.block_groups(spark, sf), fx.area(spark, sf), "geoid")
    return c.groupBy("geoid").agg(F.round(F.sum("area"), 3).alias("area"))


@query(
    "scale_by_area",
    f"""WITH {BASE}, s AS (SELECT *, {_SHARE} / ((bx1 - bx0) * (by1 - by0)) AS share FROM fx_block_groups, fx_area
      WHERE bx1 > ax0 AND bx0 < ax1 AND by1 > ay0 AND by0 < ay1)
    SELECT geoid, {", ".join(f"round(final_{k}_{m} * share, 6) AS final_{k}_{m}" for m in ("ped", "bike", "mv") for k in ("pred", "se"))} FROM s""",
)
def scale_by_area(spark, sf):
    bg = fx.block_groups(spark, sf).withColumn("area_sq_m", g.polygon_area(F.col("rings")))
    pieces = cells.clip_polygons(bg, fx.area(spark, sf), "geoid")
    s = estimates.scale_by_area(bg, pieces)
    return s.select("geoid", *[_r(f"final_{k}_{m}") for m in ("ped", "bike", "mv") for k in ("pred", "se")])


@query(
    "load_study",
    f"""WITH {BASE}, {CLIPPED} SELECT 'roads' AS input, count(*) AS n, round(sum(cx1 - cx0), 4) AS size FROM clipped
    UNION ALL SELECT 'crashes', count(*), 0 FROM fx_crashes, fx_area WHERE x BETWEEN ax0 AND ax1 AND y BETWEEN ay0 AND ay1
    UNION ALL SELECT 'block_groups', count(*), round(sum({_SHARE}), 3) FROM fx_block_groups, fx_area
      WHERE bx1 > ax0 AND bx0 < ax1 AND by1 > ay0 AND by0 < ay1""",
)
def load_study(spark, sf):
    """Intake of a whole study: roads, crashes and block groups clipped to its area."""
    bg = fx.block_groups(spark, sf).withColumn("area_sq_m", g.polygon_area(F.col("rings")))
    s = intake.load_study(fx.area(spark, sf), fx.roads(spark, sf), fx.crashes(spark, sf), bg)
    n = F.count(F.lit(1)).alias("n")
    roads = s.roads.agg(n, F.round(F.sum(g.line_length(F.col("geom"))), 4).alias("size"))
    crashes = s.crashes.agg(n, F.lit(0.0).alias("size"))
    groups = s.block_groups.agg(n, F.round(F.sum("clipped_area"), 3).alias("size"))
    named = [df.select(F.lit(k).alias("input"), "n", "size") for k, df in (("roads", roads), ("crashes", crashes), ("block_groups", groups))]
    return named[0].unionByName(named[1]).unionByName(named[2])


# Parcels on a lattice, in counties of up to 35 that touch at corners only; county 9 is scattered and leaves holes in the others.
PARCELS = """parcels AS (
  SELECT i, j, CASE WHEN p_partkey % 11 = 0 THEN 9 ELSE cast((i - i % 7) / 7 + 3 * (j - j % 5) / 5 AS bigint) % 4 END AS county FROM (
    SELECT p_partkey, cast(p_partkey % 40 AS bigint) AS i, cast((p_partkey - p_partkey % 40) / 40 AS bigint) AS j FROM part) t)"""
PARCEL_M = 120.0


@query(
    "dissolved_counties",
    f"""WITH RECURSIVE {PARCELS}, reach AS (
      SELECT county, i, j, i + 40 * j AS root FROM parcels
      UNION SELECT p.county, p.i, p.j, r.root FROM reach r JOIN parcels p ON p.county = r.county
        AND ((p.j = r.j AND (p.i = r.i + 1 OR p.i = r.i - 1)) OR (p.i = r.i AND (p.j = r.j + 1 OR p.j = r.j - 1)))),
    roots AS (SELECT county, i, j, min(root) AS root FROM reach GROUP BY ALL),
    inner_sides AS (SELECT p.county, count(*) AS n FROM parcels p JOIN parcels q ON p.county = q.county
        AND ((q.i = p.i + 1 AND q.j = p.j) OR (q.i = p.i AND q.j = p.j + 1)) GROUP BY ALL),
    nodes AS (SELECT county, i + di AS x, j + dj AS y, sum(bit) AS around, count(*) AS n FROM parcels,
        (VALUES (0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)) c(di, dj, bit) GROUP BY ALL),
    corners AS (SELECT county, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN around IN (5, 10) THEN 2 ELSE 0 END) AS corners FROM nodes GROUP BY ALL)
    SELECT cast(r.county AS bigint) AS county, count(DISTINCT root) AS parts, round(cast(count(*) AS double) * {PARCEL_M * PARCEL_M}, 3) AS area,
      round(cast(4 * count(*) - 2 * coalesce(max(s.n), 0) AS double) * {PARCEL_M}, 3) AS perimeter, cast(max(c.corners) AS bigint) AS corners
    FROM roots r JOIN corners c USING (county) LEFT JOIN inner_sides s USING (county) GROUP BY r.county""",
)
def dissolved_counties(spark, sf):
    """Parcels of one county as whole outlines with holes."""
    text = PARCELS[PARCELS.index("(") + 1 : PARCELS.rindex(")")].replace("FROM part", "FROM {part}")
    p = spark.sql(text, part=fx.read(spark, sf, "part"))
    x, y = F.col("i") * PARCEL_M, F.col("j") * PARCEL_M
    squares = p.select(F.col("county").cast("bigint").alias("county"), g.rectangle(x, y, x + PARCEL_M, y + PARCEL_M).alias("rings"))
    closed = F.transform("rings", lambda r: g.line_length(F.concat(r, F.slice(r, 1, 1))))
    length = F.aggregate(closed, F.lit(0.0), lambda a, v: a + v)
    return (
        outlines.dissolve_polygons(squares, ["county"])
        .groupBy("county")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.round(F.sum("area"), 3).alias("area"),
            F.round(F.sum(length), 3).alias("perimeter"),
            F.sum(F.size(F.flatten("rings"))).alias("corners"),
        )
    )


@query(
    "clipped_block_group_outlines",
    f"""WITH {BASE} SELECT geoid, cast(1 AS bigint) AS parts, cast(4 AS bigint) AS corners, round({_SHARE}, 3) AS area FROM fx_block_groups, fx_area
      WHERE bx1 > ax0 AND bx0 < ax1 AND by1 > ay0 AND by0 < ay1""",
)
def clipped_block_group_outlines(spark, sf):
    """One outline per clipped block group in place of its grid pieces."""
    whole = outlines.clipped_outlines(fx.block_groups(spark, sf), fx.area(spark, sf), "geoid")
    return whole.groupBy("geoid").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.size(F.flatten("rings"))).alias("corners"), F.round(F.sum("area"), 3).alias("area")
    )


# Areas around suppliers: most centres lie in a block group, some just outside all of them.
AREAS = """areas AS (
  SELECT s_suppkey AS study_id, cast((s_suppkey * 733) % 21000 + 1 AS double) AS sx0, cast((s_suppkey * 389) % 13000 + 3 AS double) AS sy0,
    cast(900 + s_suppkey % 800 AS double) AS w FROM supplier)"""


def _areas(spark, sf):
    text = AREAS[AREAS.index("(") + 1 : AREAS.rindex(")")].replace("FROM supplier", "FROM {supplier}")
    return spark.sql(text, supplier=fx.read(spark, sf, "supplier"))


@query(
    "region_of_area",
    f"""WITH {BASE}, {AREAS},
    inside AS (SELECT a.study_id, min(geoid) AS geoid FROM areas a JOIN fx_block_groups
      ON sx0 + w / 2 BETWEEN bx0 AND bx1 AND sy0 + w / 2 BETWEEN by0 AND by1 GROUP BY a.study_id),
    most AS (SELECT a.study_id, arg_max(geoid, (least(bx1, sx0 + w) - greatest(bx0, sx0)) * (least(by1, sy0 + w) - greatest(by0, sy0))) AS geoid
      FROM areas a JOIN fx_block_groups ON bx1 > sx0 AND bx0 < sx0 + w AND by1 > sy0 AND by0 < sy0 + w GROUP BY a.study_id)
    SELECT a.study_id, coalesce(i.geoid, m.geoid) AS geoid FROM areas a LEFT JOIN inside i USING (study_id) LEFT JOIN most m USING (study_id)""",
)
def region_of_area(spark, sf):
    a = _areas(spark, sf)
    w = F.col("w")
    areas = a.select("study_id", g.rectangle("sx0", "sy0", F.col("sx0") + w, F.col("sy0") + w).alias("rings"))
    return cells.region_of(areas, fx.block_groups(spark, sf).select("geoid", "rings"), "geoid")


@query(
    "line_expressions",
    """SELECT o_orderkey AS id, round(a + b, 6) AS length, round(b / 2, 6) AS cut_length, round(a, 6) AS cut_y, round(sqrt(a * a / 4 + 9), 6) AS dist
    FROM (SELECT o_orderkey, cast(10 + o_orderkey % 90 AS double) AS a, cast(20 + o_custkey % 70 AS double) AS b FROM orders) t""",
)
def line_expressions(spark, sf):
    """Length, substring and point distance of an L-shaped line per order."""
    o = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (10 + F.col("o_orderkey") % 90).cast("double").alias("a"),
        (20 + F.col("o_custkey") % 70).cast("double").alias("b"),
    )
    line = F.array(g.point(0, 0), g.point(F.lit(0.0), "a"), g.point("b", "a"))
    o = o.withColumn("line", line)
    o = o.withColumn("cut", g.line_substring(F.col("line"), F.col("a") + F.col("b") / 4, F.col("a") + F.col("b") * 0.75))
    return o.select(
        "id",
        F.round(g.line_length(F.col("line")), 6).alias("length"),
        F.round(g.line_length(F.col("cut")), 6).alias("cut_length"),
        F.round(F.element_at("cut", 1)["y"], 6).alias("cut_y"),
        F.round(g.point_segment_distance(F.lit(3.0), F.col("a") * 1.5, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("a")), 6).alias("dist"),
    )


@query(
    "ring_expressions",
    f"""WITH {AREAS} SELECT study_id, round(sx0 + w / 2, 6) AS cx, round(sy0 + w / 2, 6) AS cy, sx0 AS xmin, sy0 + w AS ymax,
      round(w * w * 3 / 4, 4) AS area FROM areas""",
)
def ring_expressions(spark, sf):
    """Area, centroid and bounding box of a square with a square hole."""
    w = F.col("w")

    def square(lo, hi):
        return g.rectangle(F.col("sx0") + w * lo, F.col("sy0") + w * lo, F.col("sx0") + w * hi, F.col("sy0") + w * hi)[0]

    a = _areas(spark, sf).withColumn("rings", F.array(square(0.0, 1.0), square(0.25, 0.75)))
    c, b = g.centroid(F.col("rings")), g.bbox(F.col("rings")[0])
    return a.select(
        "study_id", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), b["xmin"].alias("xmin"),
        b["ymax"].alias("ymax"), F.round(g.polygon_area(F.col("rings")), 4).alias("area"),
    )


PLACES = """places AS (SELECT c_custkey AS id, cast(c_custkey * 37 % 5700 AS double) / 100 - 124 AS lon,
   cast(c_custkey * 53 % 2400 AS double) / 100 + 25 AS lat FROM customer)"""


def _places(spark, sf):
    text = PLACES[PLACES.index("(") + 1 : PLACES.rindex(")")].replace("FROM customer", "FROM {customer}")
    return spark.sql(text, customer=fx.read(spark, sf, "customer"))


def _utm_sql():
    def terms(fx_, gx_):
        return " + ".join(
            f"cast('{a!r}' AS double) * {fx_}({2 * j}e0 * xi) * {gx_}({2 * j}e0 * eta)" for j, a in enumerate(p.ALPHA, 1)
        )

    k = f"cast('{p.SCALE * p.MERIDIAN_RADIUS!r}' AS double)"
    e = f"cast('{p._e!r}' AS double)"
    return f"""WITH {PLACES},
    z AS (SELECT *, cast(floor((lon + 180) / 6) AS int) + 1 AS zone FROM places),
    v AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (zone * 6 - 183)) AS dl FROM z),
    w AS (SELECT *, sinh(atanh(s) - {e} * atanh({e} * s)) AS t FROM v),
    x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM w)
    SELECT id, zone, round((eta + {terms('cos', 'sinh')}) * {k} + 500000, 3) AS x,
      round((xi + {terms('sin', 'cosh')}) * {k}, 3) AS y FROM x"""


@query("utm_points", _utm_sql())
def utm_points(spark, sf):
    z = _places(spark, sf).withColumn("zone", p.utm_zone("lon", "lat"))
    xy = features.project(z, F.col("zone"))
    return xy.select("id", "zone", _r("x", 3), _r("y", 3))


@query("utm_round_trip", f"WITH {PLACES} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM places")
def utm_round_trip(spark, sf):
    z = _places(spark, sf).withColumn("zone", p.utm_zone("lon", "lat"))
    xy = z.withColumn("u", p.to_utm(F.col("lon"), F.col("lat"), F.col("zone")))
    back = xy.withColumn("b", p.from_utm(F.col("u.x"), F.col("u.y"), F.col("zone")))
    return back.select("id", F.round("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


@query(
    "geodesic_area",
    f"""WITH {PLACES}, s AS (SELECT id, lat, 0.0066943799901413165e0 AS e2, 0.08181919084262128e0 AS e FROM places),
    q AS (SELECT id, e2, e, sin(radians(lat)) AS s0, sin(radians(lat + 0.05)) AS s1 FROM s),
    a AS (SELECT id, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0,
                 (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) AS q1 FROM q)
    SELECT id, round(6378137e0 * 6378137e0 / 2 * radians(0.1e0) * (q1 - q0) / 1000, 1) AS thousand_sq_m FROM a""",
)
def geodesic_area(spark, sf):
    """Area of a tenth-by-twentieth degree box: closed form for bands between parallels."""
    box = g.rectangle("lon", "lat", F.col("lon") + 0.1, F.col("lat") + 0.05)
    return _places(spark, sf).select("id", F.round(p.geodesic_area(box) / 1000, 1).alias("thousand_sq_m"))


@query(
    "area_frame",
    f"""WITH {PLACES} SELECT id AS study_id, round(lon + 0.1, 6) AS lon, round(lat + 0.05, 6) AS lat, round(lon, 6) AS xmin, round(lat + 0.1, 6) AS ymax,
      cast(32600 + floor((lon + 0.1 + 180) / 6) + 1 AS int) AS crs FROM places""",
)
def area_frame(spark, sf):
    area = _places(spark, sf).select(
        F.col("id").alias("study_id"), g.rectangle("lon", "lat", F.col("lon") + 0.2, F.col("lat") + 0.1).alias("rings")
    )
    f = features.area_frame(area)
    return f.select("study_id", _r("lon"), _r("lat"), _r("xmin"), _r("ymax"), "crs")
