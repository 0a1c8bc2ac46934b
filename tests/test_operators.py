"""Estimates, classes, rankings, sources and sinks."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise import domain as d
from lanewise.functions.text import pg_initcap, to_int_rounded
from lanewise.operators import classify, estimates, filters, ranking, skew, summary
from lanewise.sinks import writers
from lanewise.sources import features, tables


def test_bayes_special_cases(spark):
    """Infinite or missing variation, and fatal-only input."""
    cols = [f"est_{m}_{s}" for m in d.MODES for s in estimates.KEYS] + [f"{m}_{s}_obs" for m in d.MODES for s in estimates.KEYS]
    cases = [(0.0, 2.0), (1.0, 2.0), (float("inf"), 2.0), (float("inf"), 0.0), (None, None)]
    rows = [(i, *[cv] * 3, *[est] * 15, *[4.0] * 15) for i, (cv, est) in enumerate(cases)]
    names = ["i", *[f"{m}_cv" for m in d.MODES], *cols]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'double'}" for n in names))
    got = estimates.eb_update(df).orderBy("i").collect()
    w = 0.8 / (1 + 1.0 * 2.0)
    assert [r.w_ped_k for r in got] == [0.8, pytest.approx(w), 0.0, None, None]
    assert [r.adj_mv_o for r in got] == [pytest.approx(0.8 * 2 + 0.2 * 4), pytest.approx(w * 2 + (1 - w) * 4), 4.0, None, None]
    fatal = estimates.eb_update(df, decay=2.0, fatal_only=True)
    assert "adj_ped_a" not in fatal.columns
    assert fatal.orderBy("i").collect()[1].w_ped_k == pytest.approx(0.8 / 9)


def test_segment_variation_rules(spark):
    """Null variations keep their miles in the denominator; an empty sum is 0."""
    rows = [
        (1, "a", 0, 2.0, 0.0, 0.0, None),
        (1, "a", 0, 2.0, 4.0, 1.0, 3.0),
        (1, "a", 1, 1.0, 0.0, 0.5, None),
        (1, "a", 2, 1.0, 0.0, 0.0, None),
    ]
    names = "study_id int, dissolved_pkey string, segment_sequence int, effective_mileage double, final_pred_ped double, final_se_ped double, est_ped_k double"
    df = spark.createDataFrame(rows, names)
    for m in ("bike", "mv"):
        df = df.withColumns({f"final_pred_{m}": F.col("final_pred_ped"), f"final_se_{m}": F.col("final_se_ped"), f"est_{m}_k": F.col("est_ped_k")})
    got = {r.segment_sequence: r for r in estimates.segment_fatal(df).collect()}
    assert got[0].ped_cv == pytest.approx(0.25 * 2 / 4) and got[0].est_ped_k == 3.0
    assert math.isinf(got[1].ped_cv) and got[1].est_ped_k == 0.0
    assert got[2].ped_cv == 0.0


def test_scaling_reaches_control_totals_when_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    rows = [(1, f"k{i}", i, "g1" if i % 3 else "g2", float(i)) for i in range(30)] + [(1, "z", 0, "g3", 0.0)]
    df = spark.createDataFrame(rows, "study_id int, dissolved_pkey string, segment_sequence int, geoid string, init_ped_k double")
    controls = spark.createDataFrame([(1, "g1", 7.0), (1, "g2", 2.0), (1, "g3", 9.0)], "study_id int, geoid string, final_pred_ped double")
    out = estimates.scale_to_control(df, ["study_id", "geoid"], controls, {"init_ped_k": "final_pred_ped"}, ["dissolved_pkey"])
    sums = {r.geoid: r.s for r in out.groupBy("geoid").agg(F.sum("est_ped_k").alias("s")).collect()}
    assert sums == {"g1": pytest.approx(7), "g2": pytest.approx(2), "g3": 0.0} and out.count() == 31


def test_unknown_state_fails(spark):
    ratios = spark.createDataFrame([("AK", *[1.0] * 15)], "state string, " + ", ".join(f"{m}_{s} double" for m in d.MODES for s in estimates.KEYS))
    fatal = spark.createDataFrame([(1.0, 1.0, 1.0)], "est_ped_k double, est_bike_k double, est_mv_k double")
    assert estimates.expand_severity(fatal, ratios, "AK").first().est_mv_o == 1.0
    with pytest.raises(Exception, match="no severity ratios"):
        estimates.expand_severity(fatal, ratios, "XX").collect()


def exhaustive(values, k):
    vs = sorted(set(values))
    best = None
    for cuts in itertools.combinations(range(1, len(vs)), min(k, len(vs)) - 1):
        edges = [0, *cuts, len(vs)]
        cost = 0.0
        for a, b in zip(edges, edges[1:]):
            member = [v for v in values if vs[a] <= v <= vs[b - 1]]
            mean = sum(member) / len(member)
            cost += sum((v - mean) ** 2 for v in member)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, [vs[0], *[vs[b - 1] for b in edges[1:]]])
    return best


def total_cost(values, breaks):
    cost = 0.0
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        member = [v for v in values if (lo < v <= hi) or (i == 0 and v == lo)]
        if member:
            mean = sum(member) / len(member)
            cost += sum((v - mean) ** 2 for v in member)
    return cost


def test_natural_breaks_are_optimal(spark):
    rng = random.Random(8)
    groups = {
        "a": [rng.choice([1, 2, 3, 9, 10, 11, 30, 31, 70, 75, 200]) for _ in range(200)],
        "b": [round(rng.expovariate(0.1), 0) for _ in range(60)],
        "one": [5.0] * 9,
        "two": [1.0, 4.0, 4.0],
    }
    rows = [(n, float(v)) for n, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "grp string, v double")
    got = {r.grp: list(r.breaks) for r in classify.natural_breaks(df, "v", ["grp"], 5).collect()}
    assert got["one"][0] == 5.0 and len(got["one"]) == 2 and got["two"] == [1.0, 4.0] or got["two"] == [1.0, 1.0, 4.0]
    for n in ("a", "b"):
        assert len(got[n]) == 6 and got[n][0] == min(groups[n]) and got[n][-1] == max(groups[n])
        assert total_cost(groups[n], got[n]) == pytest.approx(exhaustive(groups[n], 5)[0], abs=1e-6)


@pytest.mark.parametrize("n", [4096, 4097])
def test_natural_breaks_have_one_rule(spark, n):
    """The limits don't jump with the number of distinct values."""
    df = spark.range(n).select(F.lit("g").alias("grp"), (F.col("id") + 100_000.0).alias("v"))
    (row,) = classify.natural_breaks(df, "v", ["grp"], 5).collect()
    assert row.breaks[0] == 100_000 and row.breaks[-1] == 100_000 + n - 1 and row.breaks[1] == 100_499
    fine = classify.natural_breaks(df, "v", ["grp"], 5, digits=6).first().breaks
    assert fine[1:-1] == pytest.approx([100_000 + n * i / 5 for i in range(1, 5)], abs=3)


def test_natural_breaks_pool_many_values(spark):
    """Values that agree in three digits count as one: limits still separate the clusters."""
    df = spark.range(30000).select(
        F.lit("g").alias("grp"),
        (F.when(F.col("id") % 3 == 0, 100.0).when(F.col("id") % 3 == 1, 5000.0).otherwise(90000.0) + F.col("id") / 1000.0).alias("v"),
    )
    (row,) = classify.natural_breaks(df, "v", ["grp"], 3).collect()
    b = row.breaks
    assert b[0] == 100.0 and 100 < b[1] < 200 and 5000 < b[2] < 5100 and b[3] == pytest.approx(90029.999)


def test_class_borders(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (0, 1, 2, 3, 4, 9, 10)], "grp string, v double")
    limits = spark.createDataFrame([("m", [1.0, 3.0, 9.0])], "grp string, breaks array<double>")
    got = {r.v: r.class_no for r in classify.assign_class(df, limits, "v", ["grp"], ["v"]).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 1, 9: 1, 10: None}


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_priority_flag(spark, monkeypatch, n):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rng = random.Random(1)
    rows = [(1, i, rng.choice([2019, 2020, None]), "ped" if i % 4 else "mv") for i in range(120)]
    got = ranking.priority_flag(spark.createDataFrame(rows, "study_id int, crash_id int, crash_year int, crash_mode string"), n).collect()
    for mode in ("ped", "mv"):
        mine = sorted((r for r in rows if r[3] == mode), key=lambda r: (-(r[2] or 0), -r[1]))
        want = {r[1] for r in mine[:n]}
        assert {r.crash_id for r in got if r.crash_mode == mode and r.priority} == want
        assert {r.mode_total for r in got if r.crash_mode == mode} == {len(mine)}


def test_top_per_group(spark):
    rows = [(i % 3, i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = skew.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 4, ["i"], ways=5).collect()
    for k in range(3):
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:4]
        assert [(r.v, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r.rank)] == [(r[1], r[2]) for r in want]


def test_initcap_and_rounding(spark):
    df = spark.createDataFrame([("st-o'neil 3RD ave", 2.5), (None, 3.5), ("", -0.5)], "s string, v double")
    got = df.select(pg_initcap(F.col("s")).alias("s"), to_int_rounded(F.col("v")).alias("v")).collect()
    assert [r.s for r in got] == ["St-O'Neil 3rd Ave", None, ""] and [r.v for r in got] == [2, 4, 0]


def test_recode_arms(spark):
    df = spark.createDataFrame([("x",), (" x",), (None,), ("  ",), ("q",)], "c string")
    m = {"x": "X", d.NULL_KEY: "N", d.EMPTY_KEY: "E"}
    assert [r.c for r in filters.recode(df, "c", m, "other").collect()] == ["X", "other", "N", "E", "other"]
    assert [r.c for r in filters.recode(df, "c", m, "other", trim=True).collect()] == ["X", "X", "N", "E", "other"]
    assert [r.c for r in filters.recode(df, "c", {"x": "X"}).collect()] == ["X", None, None, None, None]


def test_retention_keeps_rows_without_year(spark):
    df = spark.createDataFrame([(2020,), (2016,), (2015,), (None,)], "year int")
    assert sorted((r.year or 0) for r in tables.retain_recent(df).collect()) == [0, 2016, 2020]


def test_features_round_trip(spark, tmp_path, make_lines):
    roads = make_lines([(1, "a", [(1, 2), (3, 4)]), (2, "b", [(5, 6), (7, 8), (9, 9)])])
    feats = writers.to_geojson(roads, writers.line_geometry("geom"), {"road_id": "road_id", "name": "road_name"})
    writers.write_geojson(feats, str(tmp_path / "lines"))
    back = features.read_features(spark, str(tmp_path / "lines"), "geojsonl", geom_types=["LineString"], properties=["road_id", "name"])
    rows = {r.road_id: r for r in features.lines(back.rows).collect()}
    assert [(v.x, v.y) for v in rows["2"].geom] == [(5, 6), (7, 8), (9, 9)] and back.rejects.count() == 0
    collection = {"type": "FeatureCollection", "features": [json.loads(r.feature) for r in feats.collect()] + [{"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "c.json").write_text(json.dumps(collection))
    whole = features.read_features(spark, str(tmp_path / "c.json"), "geojson", properties=["name"])
    assert whole.rows.count() == 2 and [r.reason for r in whole.rejects.collect()] == ["no geometry"]
    with pytest.raises(ValueError):
        features.read_features(spark, str(tmp_path / "c.json"), crs=None)


def test_polygon_features_and_csv_points(spark, tmp_path):
    multi = {"type": "Feature", "properties": {"id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}
    (tmp_path / "p.jsonl").write_text(json.dumps(multi) + "\n")
    f = features.read_features(spark, str(tmp_path / "p.jsonl"), geom_types=["Polygon", "MultiPolygon"], properties=["id"])
    assert [(r.id, r.part, len(r.rings)) for r in features.polygons(f.rows).orderBy("part").collect()] == [("m", 0, 1), ("m", 1, 1)]
    (tmp_path / "c.csv").write_text("id,lon,lat\n1,-80.5,43\n2,bad,1\n")
    pts = features.read_features(spark, str(tmp_path / "c.csv"), "csv")
    assert [(r.id, r.lon, r.lat) for r in features.points(pts.rows).collect()] == [("1", -80.5, 43.0)] and pts.rejects.count() == 1


def test_lookup_and_result_write(spark, tmp_path):
    (tmp_path / "l.csv").write_text("state,rate\nAK,1.5\nAL,none\n")
    got = tables.load_lookup(spark, str(tmp_path / "l.csv"), ["rate"]).orderBy("state").collect()
    assert [r.rate for r in got] == [1.5, None]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "study_id int, wid string, v double")
    writers.write_result(df, out, ["wid"])
    writers.write_result(df.filter("study_id = 2").withColumn("v", F.lit(9.0)), out, ["wid"])
    assert {(r.study_id, r.v) for r in spark.read.parquet(out).collect()} == {(1, 1.0), (2, 9.0)}
    with pytest.raises(ValueError):
        writers.write_result(df.withColumn("study_id", F.lit(1)), out, ["wid"])
    writers.write_summary(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_export_types(spark):
    df = spark.sql("select true b, array('a','b') arr, cast(null as array<string>) empty, map('k',1) m, 2.345 v, 7 n")
    row = writers.export_view(df, digits={"v": 1}).first()
    assert (row.b, row.arr, row.empty, row.m, float(row.v), row.n) == (1, "a,b", "", '{"k":1}', 2.3, 7)


def test_summary_percent_halves_to_even(spark):
    cube = spark.createDataFrame([("K", 1), ("A", 799), (None, 5)], "crash_severity string, crash_count int")
    got = summary.category_summary(cube, "crash_severity", d.SEVERITIES, by=()).collect()
    assert [(r.crash_severity, r.total_crashes, r.percent_of_total) for r in got] == [("K", 1, 0.1), ("A", 799, 99.9)]
