"""Stitching of roads and windows along them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import lrs, network, skew


def lines_of(edges, name):
    rows = edges.filter(F.col("road_name").eqNullSafe(name)).orderBy("dissolved_pkey", "seq").collect()
    out = {}
    for r in rows:
        out.setdefault(r.dissolved_pkey, []).append(r)
    return list(out.values())


@pytest.fixture(scope="module")
def edges(make_lines):
    long = [(100 + k, "long", [(k, 0), (k + 1, 0)] if k % 3 else [(k + 1, 0), (k, 0)]) for k in range(37)]
    roads = make_lines(
        [
            (1, "loop", [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]),
            (2, "two-part loop", [(100, 0), (110, 0), (110, 10)]),
            (3, "two-part loop", [(110, 10), (100, 10), (100, 0)]),
            (4, "cross", [(0, 0), (10, 0)]),
            (5, "cross", [(5, -5), (5, 5)]),
            (6, "tee", [(0, 0), (10, 0)]),
            (7, "tee", [(5, 0), (5, 5)]),
            (8, "turned", [(20, 0), (10, 0)]),
            (9, "turned", [(30, 0), (20, 0)]),
            (10, "turned", [(30, 0), (40, 0)]),
            (11, "overlap", [(0, 0), (10, 0)]),
            (12, "overlap", [(5, 0), (15, 0)]),
            (13, "overlap", [(10, 0), (0, 0)]),
            (14, None, [(0, 0), (3, 4)]),
            (15, None, [(3, 4), (6, 0)]),
            (16, "Gap", [(0, 0), (10, 0)]),
            (17, "Gap", [(13, 0), (20, 0)]),
            (18, "GAP", [(10, 0), (13, 0)]),
            *long,
        ]
    )
    return network.dissolve_roads(roads).cache()


def test_gap_and_spelling_stay_apart(edges):
    lengths = sorted(p[0].length_meters for p in lines_of(edges, "gap"))
    assert lengths == [3.0, 7.0, 10.0]


def test_crossing_and_junction_split(edges):
    assert sorted(len(p) for p in lines_of(edges, "cross")) == [1, 1, 1, 1]
    assert sorted(p[0].length_meters for p in lines_of(edges, "tee")) == [5.0, 5.0, 5.0]


def test_overlap_counts_once(edges):
    (line,) = lines_of(edges, "overlap")
    assert line[0].length_meters == 15.0
    assert [r.m0 for r in line] == [0.0, 5.0, 10.0]


def test_majority_direction(edges):
    (line,) = lines_of(edges, "turned")
    assert (line[0].x0, line[-1].x1) == (40.0, 10.0)


def test_null_names_merge(edges):
    (line,) = lines_of(edges, None)
    assert [(r.x0, r.y0, r.m0, r.m1) for r in line] == [(0, 0, 0, 5), (3, 4, 5, 10)]


@pytest.mark.parametrize("name", ["loop", "two-part loop"])
def test_closed_loop_is_one_line(edges, name):
    (line,) = lines_of(edges, name)
    assert line[0].length_meters == 40.0 and len(line) == 4
    assert (line[0].x0, line[0].y0) == (line[-1].x1, line[-1].y1)
    for a, b in zip(line, line[1:]):
        assert (a.x1, a.y1, a.m1) == (b.x0, b.y0, b.m0)


def test_long_chain_is_ordered(edges):
    (line,) = lines_of(edges, "long")
    assert [r.seq for r in line] == list(range(37))
    assert [round(r.m1, 9) for r in line] == [float(i + 1) for i in range(37)]
    assert [r.x0 for r in line] == [float(i) for i in range(37)]


def test_random_network_against_brute_force(make_lines):
    """Random steps on a small grid: merged lines equal a plain walk over degree-2 nodes."""
    rng = random.Random(5)
    rows, seen = [], set()
    for i in range(160):
        x, y = rng.randrange(9), rng.randrange(9)
        dx, dy = rng.choice([(1, 0), (0, 1)])
        name = rng.choice(["p", "q"])
        if (name, x, y, dx) in seen:
            continue
        seen.add((name, x, y, dx))
        pts = [(x, y), (x + dx, y + dy)]
        rows.append((i, name, pts if rng.random() < 0.5 else pts[::-1]))
    got = network.dissolve_roads(make_lines(rows)).groupBy("road_name", "dissolved_pkey").agg(
        F.count("*").alias("n"), F.max("length_meters").alias("len")
    )
    have = sorted((r.road_name, r.n, round(r.len, 6)) for r in got.collect())

    want = []
    for name in ("p", "q"):
        segs = [frozenset(map(tuple, pts)) for _, nm, pts in rows if nm == name]
        degree = {}
        for s in segs:
            for p in s:
                degree.setdefault(p, []).append(s)
        parent = {s: s for s in segs}

        def find(s):
            while parent[s] != s:
                s = parent[s]
            return s

        for touching in degree.values():
            if len(touching) == 2:
                parent[find(touching[0])] = find(touching[1])
        sizes = {}
        for s in segs:
            sizes[find(s)] = sizes.get(find(s), 0) + 1
        want += [(name, n, float(n)) for n in sizes.values()]
    assert have == sorted(want)


def test_hot_key_noding_matches(make_lines, monkeypatch):
    """Splitting hot cells changes nothing in the result."""
    rows = [(i, "a", [(i, -3), (i + 0.5, 3)]) for i in range(12)] + [(50, "a", [(-1, 0), (13, 0.25)])]
    plain = network.dissolve_roads(make_lines(rows)).select("x0", "y0", "x1", "y1").collect()
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    salted = network.dissolve_roads(make_lines(rows)).select("x0", "y0", "x1", "y1").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted))
    assert len(plain) == 12 * 2 + 13


def line_frame(spark, lengths):
    rows = [(1, f"k{i}", "r", "Local Road", 0.0, 0.0, float(v)) for i, v in enumerate(lengths)]
    return spark.createDataFrame(
        rows,
        "study_id int, dissolved_pkey string, road_name string, functional_class string, start_x double, start_y double, length_meters double",
    )


def test_window_counts_and_bounds(spark):
    w = lrs.sliding_windows(line_frame(spark, [100.0, 500.0, 505.0]), 500.0, 100.0).collect()
    assert sorted((r.dissolved_pkey, r.window_no, r.start_distance_m, r.end_distance_m) for r in w) == [
        ("k0", 0, 0.0, 100.0),
        ("k1", 0, 0.0, 500.0),
        ("k2", 0, 0.0, 500.0),
        ("k2", 1, 100.0, 505.0),
    ]


def test_short_windows_round_half_up_and_cover(spark):
    rows = lrs.short_windows(line_frame(spark, [160.934 * 26, 0.0, 0.3]), 160.934).orderBy("segment_sequence").collect()
    long = [r for r in rows if r.dissolved_pkey == "k0"]
    assert len(long) == 26
    assert long[25].start_distance_m == 4023.4  # 4023.35 rounds up
    assert all(a.end_distance_m == b.start_distance_m for a, b in zip(long, long[1:]))
    assert [r.end_distance_m for r in rows if r.dissolved_pkey == "k2"] == [0.3]
    assert not [r for r in rows if r.dissolved_pkey == "k1"]


def test_cut_at_steps_keeps_length_on_bends(make_lines):
    e = network.dissolve_roads(make_lines([(1, "b", [(0, 0), (30, 40), (30, 140), (100, 140)])]))
    pieces = lrs.cut_at_steps(e, 37.0).orderBy("m0").collect()
    assert math.isclose(sum(math.hypot(p.x1 - p.x0, p.y1 - p.y0) for p in pieces), 220.0)
    assert {p.segment_sequence for p in pieces} == set(range(math.ceil(220 / 37)))
    for a, b in zip(pieces, pieces[1:]):
        assert math.isclose(a.x1, b.x0, abs_tol=1e-9) and math.isclose(a.y1, b.y0, abs_tol=1e-9)
    geo = lrs.window_lines(lrs.cut_at_steps(e, 37.0), [*lrs.ROAD, "segment_sequence"])
    assert geo.count() == math.ceil(220 / 37)


def test_lrs_overlap_matches_all_pairs(spark):
    rng = random.Random(3)

    def frame(n, tag):
        rows = []
        for i in range(n):
            a = rng.uniform(0, 5000)
            rows.append((1, rng.choice(["a", "b"]), f"{tag}{i}", a, a + rng.uniform(0, 900)))
        return rows

    left, right = frame(80, "l"), frame(60, "r")
    schema = "study_id int, dissolved_pkey string, id string, start_distance_m double, end_distance_m double"
    got = lrs.lrs_overlap(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), lrs.ROAD, bucket=250.0
    )
    have = {(r.id, r.id_r, round(r.overlap, 9)) for r in got.collect()}
    want = {
        (a[2], b[2], round(min(a[4], b[4]) - max(a[3], b[3]), 9))
        for a in left
        for b in right
        if a[1] == b[1] and min(a[4], b[4]) > max(a[3], b[3])
    }
    assert have == want and got.count() == len(want)


def test_range_lines_on_a_bent_road(spark):
    """Stretches of a slanted, bent line keep their length and pass through its corners."""
    corners = [(0.0, 0.0), (300.0, 400.0), (300.0, 1400.0), (1500.0, 500.0)]
    rows, m = [], 0.0
    for (x0, y0), (x1, y1) in zip(corners, corners[1:]):
        n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        rows.append((1, "k", m, m + n, x0, y0, x1, y1))
        m += n
    edges = spark.createDataFrame(rows, "study_id int, dissolved_pkey string, m0 double, m1 double, x0 double, y0 double, x1 double, y1 double")
    wanted = [(1, "k", i, a, b) for i, (a, b) in enumerate([(0.0, m), (100.0, 700.0), (500.0, 1500.0), (999.0, 2001.0), (2900.0, m)])]
    ranges = spark.createDataFrame(wanted, "study_id int, dissolved_pkey string, n int, start_distance_m double, end_distance_m double")
    got = {r.n: [(p.x, p.y) for p in r.geom] for r in lrs.range_lines(ranges, edges, ["study_id", "dissolved_pkey", "n"]).collect()}
    assert got[0] == corners
    assert got[2] == [corners[1], corners[2]]
    assert got[1][0] == pytest.approx((60, 80)) and got[1][1] == corners[1] and got[1][-1] == pytest.approx((300, 600))
    for _, _, n, a, b in wanted:
        size = sum(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 for (x0, y0), (x1, y1) in zip(got[n], got[n][1:]))
        assert size == pytest.approx(b - a)


def test_lines_through_one_point_share_a_node(spark, make_lines):
    """Any number of lines through one interior point are cut there once."""
    rng = random.Random(3)
    for lines in (3, 5):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        rows = []
        for i in range(lines):
            a, n = rng.uniform(0, 3.14), rng.uniform(40, 90)
            dx, dy = n * math.cos(a), n * math.sin(a)
            rows.append((i, "main", [(x - dx, y - dy), (x + dx * 0.7, y + dy * 0.7)]))
        got = network.dissolved_lines(network.dissolve_roads(make_lines(rows))).collect()
        assert len(got) == 2 * lines and min(r.length_meters for r in got) > 1
