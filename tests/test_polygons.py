"""Clipping, containment and areas with concave polygons and holes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as g
from lanewise.functions import projection as p
from lanewise.operators import cells, skew

# A concave study area with a rectangular hole; the left border lies on a grid line.
AREA = [
    [(0, 0), (3000, 0), (3000, 900), (1500, 900), (1500, 1700), (3000, 1700), (3000, 2600), (0, 2600)],
    [(300, 300), (300, 700), (800, 700), (800, 300)],
]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


@pytest.mark.parametrize("hot_rows", [200_000, 10])
def test_points_in_area(spark, make_polygons, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rng = random.Random(4)
    pts = [(1, i, rng.uniform(-500, 3500), rng.uniform(-500, 3100)) for i in range(1500)]
    border = [(1, 9001, 0.0, 1000.0), (1, 9002, 3000.0, 500.0), (1, 9003, 300.0, 500.0), (1, 9004, 1500.0, 1000.0)]
    outside = [(1, 9101, 2000.0, 1200.0), (1, 9102, 500.0, 500.0), (1, 9103, 3000.0, 1000.0), (1, 9104, 2000.0, 1000.0)]
    df = spark.createDataFrame(pts + border + outside, "study_id int, pid int, x double, y double")
    got = {r.pid for r in cells.points_in(df, make_polygons([("a", AREA)]), 1000.0).collect()}
    assert got == {i for _, i, x, y in pts if inside(x, y, AREA)} | {9001, 9002, 9003, 9004}


def test_other_study_does_not_match(spark, make_polygons):
    df = spark.createDataFrame([(2, 1, 100.0, 100.0)], "study_id int, pid int, x double, y double")
    assert cells.points_in(df, make_polygons([("a", AREA)])).count() == 0


def test_tiles_keep_area(make_polygons):
    tiles = cells.tile_polygons(make_polygons([("a", AREA)]), 700.0)
    total = tiles.agg(F.sum(g.polygon_area(F.col("rings")))).first()[0]
    assert total == pytest.approx(3000 * 2600 - 1500 * 800 - 500 * 400)


def test_clip_polygons_against_sampling(spark, make_polygons):
    """Clipped areas agree with the share of a fine lattice of points inside both."""
    tri = [[(-400, -300), (2900, 500), (700, 2900)]]
    got = cells.clip_polygons(make_polygons([("t", tri)]), make_polygons([("a", AREA)]), "geoid", 1000.0)
    area = got.agg(F.sum("area")).first()[0]
    step = 10
    hits = sum(
        inside(x + 5.1, y + 5.3, AREA) and inside(x + 5.1, y + 5.3, tri)
        for x in range(-400, 3000, step)
        for y in range(-300, 2900, step)
    )
    assert area == pytest.approx(hits * step * step, rel=5e-3)


def test_clip_lines_against_sampling(spark, make_lines, make_polygons):
    roads = make_lines(
        [
            (1, "through", [(-100, 2000), (3500, 2000)]),
            (2, "in and out", [(2000, 100), (2000, 2500)]),
            (3, "over the hole", [(100, 500), (1200, 500)]),
            (4, "inside", [(100, 100), (200, 150), (900, 200)]),
            (5, "outside", [(4000, 0), (5000, 10)]),
            (6, "bent", [(-50, 1000), (400, 1300), (1600, 1300), (2500, 2000)]),
        ]
    )
    got = cells.clip_lines(roads, make_polygons([("a", AREA)]), "road_id", 1000.0)
    rows = got.select("road_id", "part", g.line_length(F.col("geom")).alias("len"), "geom").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.road_id, []).append(r.len)
    assert sorted(parts) == [1, 2, 3, 4, 6]
    assert parts[1] == [pytest.approx(3000)]
    assert sorted(parts[2]) == [pytest.approx(800), pytest.approx(800)]
    assert sorted(parts[3]) == [pytest.approx(200), pytest.approx(400)]
    assert parts[4] == [pytest.approx(math.hypot(100, 50) + math.hypot(700, 50))]
    # the bent road leaves through x = 1500 at y = 1300 and comes back above y = 1700
    a = math.hypot(400, 300 * 400 / 450) + 1100
    t = 400 / 700
    b = math.hypot(900, 700) * (1 - t)
    assert sorted(parts[6]) == [pytest.approx(b), pytest.approx(a)]
    inner = [r for r in rows if r.road_id == 4][0]
    assert [(v.x, v.y) for v in inner.geom] == [(100, 100), (200, 150), (900, 200)]


def test_buffer_overlap_of_slanted_edge(spark, make_polygons):
    e = spark.createDataFrame([(1, 7, 100.0, 100.0, 900.0, 700.0)], "study_id int, eid int, x0 double, y0 double, x1 double, y1 double")
    whole = [[(-5000, -5000), (5000, -5000), (5000, 5000), (-5000, 5000)]]
    left = [[(-5000, -5000), (500, -5000), (500, 5000), (-5000, 5000)]]
    tiles = cells.tile_polygons(make_polygons([("w", whole), ("l", left)]), 300.0)
    got = {r.geoid: r.piece_area for r in cells.buffer_overlap(e, tiles, ["eid"], "geoid", 15.0, 300.0).collect()}
    assert got["w"] == pytest.approx(1000 * 30)
    assert got["l"] == pytest.approx(1000 * 30 / 2)


def test_region_falls_back_to_largest_overlap(spark, make_polygons):
    def box(x0, y0, x1, y1):
        return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]

    regions = make_polygons([("A", box(0, 0, 1000, 1000)), ("B", box(1400, 0, 3000, 1000))], "code").drop("study_id")
    areas = make_polygons([(1, box(100, 100, 300, 300)), (2, box(900, 0, 1900, 900)), (3, box(8000, 0, 9000, 100))], "s")
    areas = areas.drop("study_id").withColumnRenamed("s", "study_id")
    areas = areas.withColumn("study_id", F.col("study_id").cast("int"))
    got = {r.study_id: r.code for r in cells.region_of(areas, regions, "code").collect()}
    # the centre of area 2 is at x = 1400, on the border of B; shifted left it is in neither
    assert got == {1: "A", 2: "B", 3: None}
    moved = make_polygons([(2, box(850, 0, 1600, 900))], "s").drop("study_id").withColumnRenamed("s", "study_id")
    moved = moved.withColumn("study_id", F.col("study_id").cast("int"))
    assert cells.region_of(moved, regions, "code").first().code == "B"


def test_known_projection_values(spark):
    """A published control point: the CN Tower, zone 17, within a metre."""
    xy = spark.range(1).select(p.to_utm(F.lit(-79.387139), F.lit(43.642567), F.lit(17)).alias("u")).first().u
    assert xy.x == pytest.approx(630084, abs=1.5) and xy.y == pytest.approx(4833439, abs=1.5)
    zones = spark.range(1).select(
        p.utm_zone(F.lit(-79.4), F.lit(43.6)).alias("a"), p.utm_zone(F.lit(4.0), F.lit(60.0)).alias("b"),
        p.utm_zone(F.lit(15.0), F.lit(78.0)).alias("c"), p.utm_epsg(F.lit(-79.4), F.lit(-10.0)).alias("d"),
    ).first()
    assert tuple(zones) == (17, 32, 33, 32617)


def test_road_along_border_is_kept(make_lines, make_polygons):
    roads = make_lines([(1, "east border", [(3000, 100), (3000, 800)]), (2, "notch", [(2000, 950), (2000, 1650)])])
    got = cells.clip_lines(roads, make_polygons([("a", AREA)]), "road_id", 1000.0)
    assert [(r.road_id, r.l) for r in got.select("road_id", g.line_length(F.col("geom")).alias("l")).collect()] == [(1, 700.0)]


def test_point_in_rings_function(spark, make_polygons):
    rng = random.Random(9)
    pts = [(i, rng.uniform(-100, 3100), rng.uniform(-100, 2700)) for i in range(400)]
    df = spark.createDataFrame(pts, "pid int, x double, y double").join(make_polygons([("a", AREA)]))
    got = {r.pid for r in df.filter(g.point_in_rings(F.col("x"), F.col("y"), F.col("rings"))).collect()}
    assert got == {i for i, x, y in pts if inside(x, y, AREA)}


def test_trapezoids_cover_polygon(spark, make_polygons):
    quads = make_polygons([("a", AREA)]).select(F.explode(g.trapezoids(F.col("rings"))).alias("q"))
    total = quads.agg(F.sum(g.signed_area(F.col("q")))).first()[0]
    assert total == pytest.approx(3000 * 2600 - 1500 * 800 - 500 * 400)
