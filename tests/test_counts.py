"""Observed counts: kernel, smoothing, nearest segments, proportional sums, whole workflow."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lanewise.operators import counts as k
from lanewise.operators import estimates as e
from lanewise.operators import lrs, network, skew, summary
from lanewise.operators.cells import within_distance


def test_kernel_shapes():
    lin = k.kernel(2, "linear")
    assert len(lin) == 5 and lin == lin[::-1] and max(lin) == lin[2]
    assert k.kernel(2, "uniform") == [1.0] * 5
    with pytest.raises(ValueError):
        k.kernel(2, "cubic")


def brute_smooth(values, half, style="linear"):
    w, n, out = k.kernel(half, style), len(values), [0.0] * len(values)
    for j, v in enumerate(values):
        norm = sum(w[o + half] for o in range(-half, half + 1) if 0 <= j + o < n)
        for o in range(-half, half + 1):
            if 0 <= j + o < n:
                out[j + o] += v * w[o + half] / norm
    return out


def smooth(spark, roads, half, style="linear"):
    rows = [(r, i, float(v)) for r, vs in roads.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "road string, seq int, v double")
    out = k.smooth_along(df, ["v"], ["road"], "seq", half, style).orderBy("road", "seq").collect()
    return {r: [x.v for x in out if x.road == r] for r in roads}


@pytest.mark.parametrize(
    "roads,half,style",
    [
        ({"a": [0, 0, 0, 0, 10, 0, 0, 0, 0, 0]}, 2, "linear"),
        ({"a": [10, 10, 0, 0, 0]}, 2, "uniform"),
        ({"a": [10, 0, 0], "b": [0, 0, 20]}, 1, "linear"),
        ({"a": [7], "b": [1, 2, 3], "c": list(range(9)), "d": [i % 4 for i in range(40)]}, 4, "linear"),
    ],
)
def test_smoothing_matches_definition_and_keeps_totals(spark, roads, half, style):
    got = smooth(spark, roads, half, style)
    for r, vs in roads.items():
        assert got[r] == pytest.approx(brute_smooth(vs, half, style), abs=1e-12)
        assert sum(got[r]) == pytest.approx(sum(vs))


def test_zero_half_width_changes_nothing(spark):
    assert smooth(spark, {"a": [10, 0, 0]}, 0) == {"a": [10.0, 0.0, 0.0]}


SEG = "study_id int, dissolved_pkey string, segment_sequence int, start_distance_m double, end_distance_m double"


def proportional(spark, segments, windows, cols=("v",)):
    vals = ", ".join(f"{c} double" for c in cols)
    s = spark.createDataFrame([(1, r, i, float(b), float(t), *map(float, v)) for i, (r, b, t, *v) in enumerate(segments)], f"{SEG}, {vals}")
    w = spark.createDataFrame([(1, r, i, float(b), float(t)) for i, (r, b, t) in enumerate(windows)], SEG)
    pairs = lrs.lrs_overlap(s, w, lrs.ROAD, bucket=50.0)
    out = k.proportional_sum(pairs, list(cols), ["segment_sequence_r"]).orderBy("segment_sequence_r").collect()
    return [[r[c] for c in cols] for r in out]


def test_proportional_aligned(spark):
    got = proportional(spark, [("a", 0, 25, 1), ("a", 25, 50, 3), ("a", 50, 75, 2), ("a", 75, 100, 4)], [("a", 0, 50), ("a", 50, 100)])
    assert got == [[4.0], [6.0]]


def test_proportional_straddling(spark):
    assert proportional(spark, [("a", 40, 60, 10)], [("a", 0, 50), ("a", 50, 100)]) == [[5.0], [5.0]]


def test_proportional_total_columns_roads_and_stub(spark):
    four = [("a", 0, 25, 1), ("a", 25, 50, 2), ("a", 50, 75, 3), ("a", 75, 100, 4)]
    assert sum(r[0] for r in proportional(spark, four, [("a", 0, 60), ("a", 60, 100)])) == pytest.approx(10)
    two = proportional(spark, [("a", 0, 50, 3, 0), ("a", 50, 100, 0, 5)], [("a", 0, 100)], ("v", "u"))
    assert two == [[3.0, 5.0]]
    roads = [("a", 0, 50, 10), ("a", 50, 100, 0), ("b", 0, 50, 0), ("b", 50, 100, 20)]
    assert proportional(spark, roads, [("a", 0, 50), ("a", 50, 100), ("b", 0, 50), ("b", 50, 100)]) == [[10.0], [0.0], [0.0], [20.0]]
    stub = proportional(spark, [("a", 0, 50, 1), ("a", 50, 100, 2), ("a", 100, 120, 3)], [("a", 0, 50), ("a", 50, 100), ("a", 100, 120)])
    assert stub[2] == [3.0]


def crash_frame(spark, rows):
    return spark.createDataFrame(
        [(1, i, 2020, m, s, float(x), float(y)) for i, (x, y, m, s) in enumerate(rows)],
        "study_id int, crash_id bigint, crash_year int, crash_mode string, crash_severity string, x double, y double",
    )


def test_nearest_segment_one_road(spark, make_lines):
    edges = network.dissolve_roads(make_lines([(1, "a", [(0, 0), (150, 0)])]))
    got = e.nearest_segments(edges, crash_frame(spark, [(55, 3, "ped", "K"), (10, 5, "mv", "O"), (20, 5, "mv", "O")]), 50.0, 50.0)
    assert sorted((r.x, r.fine_no) for r in got.collect()) == [(10.0, 0), (20.0, 0), (55.0, 1)]


def test_nearest_counts_on_every_road(spark, make_lines):
    edges = network.dissolve_roads(make_lines([(1, "a", [(0, 0), (100, 0)]), (2, "b", [(0, 20), (100, 20)])]))
    got = e.nearest_segments(edges, crash_frame(spark, [(50.5, 10, "ped", "K")]), 50.0, 25.0)
    assert got.count() == 2 and got.select("dissolved_pkey").distinct().count() == 2


def test_workflow_preserves_counts(spark, make_lines):
    edges = network.dissolve_roads(make_lines([(1, "a", [(0, 0), (200, 0)])]))
    crashes = crash_frame(spark, [(30, 2, "ped", "K"), (120, 3, "bike", "A"), (50, 1000, "mv", "K")])
    obs = e.observed_counts(edges, crashes, 100.0, 50.0, 20.0, half=1)
    total = obs.agg(F.sum("ped_k_obs").alias("p"), F.sum("bike_a_obs").alias("b"), F.sum("mv_k_obs").alias("m")).first()
    assert (total.p, total.b, total.m) == (pytest.approx(1), pytest.approx(1), 0)


def test_no_match_gives_no_rows(spark, make_lines):
    edges = network.dissolve_roads(make_lines([(1, "a", [(0, 0), (200, 0)])]))
    assert e.observed_counts(edges, crash_frame(spark, [(50, 1000, "ped", "K")]), 100.0, 50.0, 10.0).count() == 0


def _distance(px, py, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - x0 - t * dx, py - y0 - t * dy), t * math.hypot(dx, dy)


def test_each_study_has_its_own_distance(spark):
    rng = random.Random(12)
    far = {1: 5.0, 2: 180.0, 3: 900.0}
    edges = [(s, i, *(rng.uniform(-900, 900) for _ in range(4)), far[s]) for s in far for i in range(25)]
    points = [(s, i, rng.uniform(-900, 900), rng.uniform(-900, 900), far[s]) for s in far for i in range(40)]
    got = within_distance(
        spark.createDataFrame(edges, "study_id int, eid int, x0 double, y0 double, x1 double, y1 double, d double"),
        spark.createDataFrame(points, "study_id int, pid int, x double, y double, d double"),
        "d",
    ).collect()
    want = {(s, i, j) for s, i, *seg, _ in edges for t, j, x, y, _ in points if s == t and _distance(x, y, *seg)[0] <= far[s]}
    assert len(got) == len(want) and {(r.study_id, r.eid, r.pid) for r in got} == want


@pytest.mark.parametrize("hot_rows", [200_000, 5])
def test_distance_join_against_all_pairs(spark, monkeypatch, hot_rows):
    """Slanted and long edges, points in clusters, with and without splitting of hot cells."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rng = random.Random(11)
    edges = [(1, i, *(rng.uniform(-900, 900) for _ in range(4))) for i in range(60)]
    points = [(1, i, rng.gauss(0, 40) if i % 3 == 0 else rng.uniform(-900, 900), rng.gauss(0, 40) if i % 3 == 0 else rng.uniform(-900, 900)) for i in range(300)]
    d = 21.0
    got = within_distance(
        spark.createDataFrame(edges, "study_id int, eid int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(points, "study_id int, pid int, x double, y double"),
        d,
    ).collect()
    want = {}
    for _, i, *seg in edges:
        for _, j, x, y in points:
            dist, near = _distance(x, y, *seg)
            if dist <= d:
                want[i, j] = (dist, near)
    assert len(got) == len(want) and {(r.eid, r.pid) for r in got} == set(want)
    seg = {i: s for _, i, *s in edges}
    place = {j: (x, y) for _, j, x, y in points}
    for r in got:
        dist, near = want[r.eid, r.pid]
        assert r.dist == pytest.approx(dist, abs=1e-7) and r.near_m == pytest.approx(near, abs=1e-6)
        x0, y0, x1, y1 = seg[r.eid]
        length = math.hypot(x1 - x0, y1 - y0)
        for m in (r.reach_lo, r.reach_hi):
            q = (x0 + (x1 - x0) * m / length, y0 + (y1 - y0) * m / length)
            assert math.dist(q, place[r.pid]) <= d + 1e-6


def test_window_counts_on_bent_roads_match_geometry(spark, make_lines):
    """Windows found through measures equal windows found by distance to their geometry."""
    rng = random.Random(2)
    pts = [(0.0, 0.0)]
    for _ in range(25):
        pts.append((pts[-1][0] + rng.uniform(5, 60), pts[-1][1] + rng.uniform(-50, 50)))
    edges = network.dissolve_roads(make_lines([(1, "bent", pts)]), node_crossings=False).cache()
    crashes = crash_frame(spark, [(rng.uniform(0, pts[-1][0]), rng.choice(pts)[1] + rng.uniform(-40, 40), "ped", "K") for _ in range(150)])
    window, step, d = 200.0, 40.0, 15.24
    hits = within_distance(edges, k.collapse_points(crashes), d)
    got = {
        (r.x, r.y, r.window_no) for r in k.windows_reached(hits, window, step).select("x", "y", "window_no").collect()
    }
    rows = edges.orderBy("seq").collect()
    length = rows[0].length_meters
    n = 1 if length <= window else math.ceil((length - window) / step) + 1
    want = set()
    for c in crashes.collect():
        for w in range(n):
            lo, hi = step * w, min(window + step * w, length)
            best = math.inf
            for r in rows:
                a, b = max(lo, r.m0), min(hi, r.m1)
                if a < b:
                    f = lambda m: (r.x0 + (r.x1 - r.x0) * (m - r.m0) / (r.m1 - r.m0), r.y0 + (r.y1 - r.y0) * (m - r.m0) / (r.m1 - r.m0))
                    best = min(best, _distance(c.x, c.y, *f(a), *f(b))[0])
            if best <= d:
                want.add((c.x, c.y, w))
    assert got == want and want


def test_plans_have_no_nested_loops(spark, make_lines):
    edges = network.dissolve_roads(make_lines([(1, "a", [(0, 0), (150, 0)])]))
    plans = [
        within_distance(edges, crash_frame(spark, [(1, 1, "ped", "K")]), 15.0),
        e.observed_counts(edges, crash_frame(spark, [(1, 1, "ped", "K")]), 100.0),
        lrs.lrs_overlap(
            lrs.short_windows(network.dissolved_lines(edges), 50.0), lrs.short_windows(network.dissolved_lines(edges), 70.0), lrs.ROAD
        ),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_growing_sides_are_not_broadcast_on_an_estimate(spark, make_lines, tmp_path):
    """Tables this small all pass for broadcasts; only the bounded list of hot keys may be one."""

    def read(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    roads = read(make_lines([(1, "a", [(0, 0), (150, 0)])]), "roads")
    crashes = read(crash_frame(spark, [(1, 1, "ped", "K")]).withColumn("crash_id", F.xxhash64("x")), "crashes")
    steps = "study_id int, dissolved_pkey string, segment_sequence int, start_distance_m double, end_distance_m double"
    steps = read(spark.createDataFrame([(1, "a", 0, 0.0, 50.0), (1, "a", 1, 50.0, 100.0)], steps), "steps")
    key = [*lrs.ROAD, "segment_sequence"]
    plans = {
        "_salt": within_distance(network.line_edges(roads), crashes, 15.0),
        "crash_id": summary.nearest_road(crashes, roads, 15.0),
        "_bucket": lrs.lrs_overlap(steps, steps, lrs.ROAD),
        "segment_sequence": k.left_fill(steps, steps.select(*key), key, []),
    }
    for column, df in plans.items():
        joins = re.findall(r"(\w+Join) ([^\n]*)", df._jdf.queryExecution().executedPlan().toString())
        assert {kind for kind, on in joins if column in on} == {"SortMergeJoin"}, (column, joins)
