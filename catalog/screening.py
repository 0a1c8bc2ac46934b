"""Queries over the road network and the sliding windows analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise import domain as d
from lanewise.functions.geometry import line_length
from lanewise.operators import counts as k
from lanewise.operators import lrs, network, ranking
from lanewise.operators.cells import within_distance
from lanewise.operators.filters import drop_omitted, flag_modes, last_n_years
from lanewise.operators.skew import shuffled
from lanewise.plans import swa, views
from lanewise.sources.tables import study_params

from . import fixtures as fx
from .registry import edges, query, screening
from .sqltext import (
    CHAINS, FINE, JOIN, SCREENING, SHORT, SHORT_SCORES, SLIDING, STEP, STUDY_CRASHES, WINDOW, counted_sql, distance,
    initcap, near, num, segments, sliding_sql,
)

LINE = ["road_name", "functional_class", "start_x", "start_y"]
PARAMS = swa.SwaParams()


def _r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


@query(
    "dissolve_roads",
    f"WITH {CHAINS} SELECT road_name, functional_class, start_x, start_y, round(length_meters, 6) AS length_meters FROM chains",
)
def dissolve(spark, sf):
    lines = network.dissolved_lines(edges(spark, sf))
    return lines.select(*LINE, _r("length_meters"))


@query(
    "dissolved_edges",
    f"""WITH {CHAINS} SELECT lower(road_name) AS road_name, functional_class, x0, y0, x1,
       round(x0 - min(x0) OVER w, 6) AS m0, round(x1 - min(x0) OVER w, 6) AS m1
    FROM islands WINDOW w AS (PARTITION BY islands.road_name, functional_class, y0, isl)""",
)
def dissolved_edges(spark, sf):
    return edges(spark, sf).select("road_name", "functional_class", "x0", "y0", "x1", _r("m0"), _r("m1"))


@query(
    "window_count",
    f"WITH {CHAINS}, {SLIDING} SELECT DISTINCT start_x, start_y, round(length_meters, 6) AS length_meters, num_windows FROM sliding",
)
def window_count(spark, sf):
    lines = lrs.window_count(network.dissolved_lines(edges(spark, sf)), WINDOW, STEP)
    return lines.select("start_x", "start_y", _r("length_meters"), "num_windows")


@query(
    "sliding_windows",
    f"""WITH {CHAINS}, {SLIDING} SELECT road_name, functional_class, start_x, start_y, cast(window_no AS int) AS window_no,
      round(start_distance_m, 6) AS start_distance_m, round(end_distance_m, 6) AS end_distance_m FROM sliding""",
)
def sliding_windows(spark, sf):
    w = lrs.sliding_windows(network.dissolved_lines(edges(spark, sf)), WINDOW, STEP)
    return w.select(*LINE, "window_no", _r("start_distance_m"), _r("end_distance_m"))


def _segments_sql(name, step):
    return f"""WITH {CHAINS}, {segments(name, step)} SELECT road_name, functional_class, start_x, start_y,
      cast(segment_sequence AS int) AS segment_sequence, start_distance_m, end_distance_m FROM {name}"""


def _segments(spark, sf, step, key):
    w = lrs.short_windows(network.dissolved_lines(edges(spark, sf)), step, key)
    return w.select(*LINE, "segment_sequence", "start_distance_m", "end_distance_m")


@query("short_windows", _segments_sql("short_windows", STEP))
def short_windows(spark, sf):
    return _segments(spark, sf, STEP, "short_window_id")


@query("fine_segments", _segments_sql("fine_segments", FINE))
def fine_segments(spark, sf):
    return _segments(spark, sf, FINE, "short_0p05mi_window_id")


@query(
    "window_pieces",
    f"""WITH {CHAINS}, {SHORT} SELECT s.start_x, s.start_y, cast(s.segment_sequence AS int) AS segment_sequence,
      round(s.start_x + s.exact_start, 6) AS line_x0, round(s.start_x + s.exact_end, 6) AS line_x1,
      round(s.exact_end - s.exact_start, 6) AS line_length FROM short_windows s""",
)
def window_pieces(spark, sf):
    """Geometry of every short window, cut out of the stitched edges."""
    cut = lrs.cut_at_steps(edges(spark, sf), STEP)
    lines = lrs.window_lines(cut, [*lrs.ROAD, "segment_sequence"])
    starts = network.dissolved_lines(edges(spark, sf)).select(*lrs.ROAD, "start_x", "start_y")


    return lines.join(shuffled(starts), lrs.ROAD).select(
        "start_x",
        "start_y",
        "segment_sequence",
        F.round(F.element_at("geom", 1)["x"], 6).alias("line_x0"),
        F.round(F.element_at("geom", -1)["x"], 6).alias("line_x1"),
        F.round(line_length(F.col("geom")), 6).alias("line_length"),
    )


@query(
    "distance_pairs",
    f"""WITH {fx.cte('fx_roads', 'fx_crashes')} SELECT r.road_id, c.crash_id,
      round({distance('c', 'r.x0', 'r.x1', 'r.y0')}, 6) AS dist
      FROM fx_roads r JOIN fx_crashes c ON {near('r', 'r.x0', 'r.x1', 'r.y0')}""",
)
def distance_pairs(spark, sf):
    e = network.line_edges(fx.roads(spark, sf).select("study_id", "road_id", "geom"))
    pairs = within_distance(e, fx.crashes(spark, sf).select("study_id", "crash_id", "x", "y"), JOIN, salt_on=("crash_id",))
    return pairs.select("road_id", "crash_id", _r("dist"))


_T = """least(greatest(((c.x - r.x0) * (r.x1 - r.x0) + (c.y - r.y0) * (r.y1 - r.y0))
        / ((r.x1 - r.x0) * (r.x1 - r.x0) + (r.y1 - r.y0) * (r.y1 - r.y0)), 0e0), 1e0)"""


@query(
    "distance_pairs_slanted",
    f"""WITH {fx.cte('fx_slanted_roads', 'fx_slanted_crashes')},
    t AS (SELECT r.road_id, c.crash_id, c.x, c.y, r.x0, r.y0, r.x1, r.y1, {_T} AS t
          FROM fx_slanted_roads r JOIN fx_slanted_crashes c
            ON c.x >= r.x0 - {num(JOIN)} AND c.x <= r.x1 + {num(JOIN)} AND c.y >= r.y0 - {num(JOIN)} AND c.y <= r.y1 + {num(JOIN)}),
    s AS (SELECT road_id, crash_id, sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0))
                                      + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))) AS dist FROM t)
    SELECT road_id, crash_id, round(dist, 6) AS dist FROM s WHERE dist <= {num(JOIN)}""",
)
def distance_pairs_slanted(spark, sf):
    e = network.line_edges(fx.roads(spark, sf, slanted=True).select("study_id", "road_id", "geom"))
    points = fx.crashes(spark, sf, slanted=True).select("study_id", "crash_id", "x", "y")
    return within_distance(e, points, JOIN, salt_on=("crash_id",)).select("road_id", "crash_id", _r("dist"))


_COUNT_LIST = ", ".join([*d.COUNT_COLUMNS, *d.SCORE_COLUMNS])


@query(
    "swa_window_counts",
    f"""WITH {SCREENING} SELECT road_name, functional_class, start_x, start_y, cast(window_no AS int) AS window_no,
      {_COUNT_LIST} FROM scored""",
)
def swa_window_counts(spark, sf):
    _, sliding, _ = screening(spark, sf)
    return sliding.select(*LINE, "window_no", *d.COUNT_COLUMNS, *d.SCORE_COLUMNS)


@query(
    "swa_short_window_scores",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES}
    SELECT road_name, functional_class, start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      start_distance_m, end_distance_m, {", ".join(d.SCORE_COLUMNS)} FROM short_scores""",
)
def swa_short_window_scores(spark, sf):
    _, _, short = screening(spark, sf)
    return short.select(*LINE, "segment_sequence", "start_distance_m", "end_distance_m", *d.SCORE_COLUMNS)


@query(
    "run_swa",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES}
    SELECT functional_class, count(*) AS windows, {", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in d.SCORE_COLUMNS)}
    FROM short_scores GROUP BY functional_class""",
)
def run_swa(spark, sf):
    """The whole analysis from raw roads and crashes, stitching included."""
    r = swa.run_swa(fx.roads(spark, sf), fx.crashes(spark, sf))
    return r.short.groupBy("functional_class").agg(
        F.count(F.lit(1)).alias("windows"), *[F.sum(c).alias(c) for c in d.SCORE_COLUMNS]
    )


def _top_sql(mode):
    score = d.score_column(mode)
    return f"""WITH {SCREENING},
    best AS (SELECT * FROM (
      SELECT *, end_distance_m - start_distance_m AS len, row_number() OVER (PARTITION BY road_name, functional_class
               ORDER BY {score} DESC, end_distance_m - start_distance_m DESC) AS rn
      FROM scored WHERE {score} > 0) t WHERE rn = 1)
    SELECT {initcap('road_name')} AS road_name, functional_class, {score} AS crash_score, round(len, 6) AS length
    FROM best ORDER BY {score} DESC, len DESC, best.road_name ASC NULLS LAST, functional_class LIMIT 10"""


def _top(mode):
    def run(spark, sf):
        _, sliding, _ = screening(spark, sf)
        return ranking.top_corridors(sliding, mode).select("road_name", "functional_class", "crash_score", _r("length"))

    return run


for _m in d.MODES:
    query(f"top_corridors_{_m}", _top_sql(_m))(_top(_m))


def _ends(df):
    """Both ends and the length of a line column, as checked."""
    return df.withColumns(
        {
            "line_x0": F.round(F.element_at("geom", 1)["x"], 4),
            "line_y0": F.round(F.element_at("geom", 1)["y"], 4),
            "line_x1": F.round(F.element_at("geom", -1)["x"], 4),
            "line_length": F.round(line_length(F.col("geom")), 4),
        }
    ).drop("geom")


@query(
    "sliding_window_lines",
    f"""WITH {CHAINS}, {SLIDING} SELECT start_x, start_y, cast(window_no AS int) AS window_no,
      round(start_x + start_distance_m, 4) AS line_x0, start_y AS line_y0, round(start_x + end_distance_m, 4) AS line_x1,
      round(end_distance_m - start_distance_m, 4) AS line_length FROM sliding""",
)
def sliding_window_lines(spark, sf):
    """Geometry of every sliding window, cut out of the stitched edges."""
    stitched = edges(spark, sf)
    lines = network.dissolved_lines(stitched)
    windows = lrs.sliding_windows(lines, WINDOW, STEP)
    cut = _ends(lrs.range_lines(windows, stitched, [*lrs.ROAD, "window_no"]))
    return cut.join(shuffled(lines.select(*lrs.ROAD, "start_x", "start_y")), lrs.ROAD).drop(*lrs.ROAD)


@query(
    "swa_view_lines",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES}
    SELECT s.start_x, s.start_y, cast(s.segment_sequence AS int) AS segment_sequence, round(s.start_x + w.exact_start, 4) AS line_x0,
      s.start_y AS line_y0, round(s.start_x + w.exact_end, 4) AS line_x1, round(w.exact_end - w.exact_start, 4) AS line_length
    FROM short_scores s JOIN short_windows w USING (start_x, start_y, segment_sequence) WHERE {" OR ".join(f"s.{c} > 0" for c in d.SCORE_COLUMNS)}""",
)
def swa_view_lines(spark, sf):
    _, _, short = screening(spark, sf)
    v = views.swa_view(short, edges(spark, sf), STEP)
    return _ends(v.select("start_x", "start_y", "segment_sequence", "geom"))


@query(
    "top_corridor_lines",
    f"""WITH {SCREENING}, best AS (SELECT road_name, functional_class, max(ped_crash_score) AS crash_score FROM scored
      WHERE ped_crash_score > 0 GROUP BY 1, 2)
    SELECT crash_score, count(*) AS corridors, cast(count(*) AS bigint) AS with_line FROM best GROUP BY 1""",
)
def top_corridor_lines(spark, sf):
    """Every score: how many corridors, and how many of them have a line of their own length."""
    _, sliding, _ = screening(spark, sf)
    top = ranking.top_corridors(sliding, "ped", 2**31 - 1, edges(spark, sf))
    fits = F.abs(line_length(F.col("geom")) - F.col("length")) < 1e-3
    return top.groupBy("crash_score").agg(F.count(F.lit(1)).alias("corridors"), F.count_if(fits).alias("with_line"))


@query(
    "best_window_per_road",
    f"""WITH {SCREENING} SELECT road_name, functional_class, max(ped_crash_score) AS crash_score
    FROM scored WHERE ped_crash_score > 0 GROUP BY road_name, functional_class""",
)
def best_window_per_road(spark, sf):
    _, sliding, _ = screening(spark, sf)
    return ranking.best_per_road(sliding, "ped").select("road_name", "functional_class", "crash_score")




def _in_two(df, y):
    return df.withColumn("study_id", (1 + F.floor(y / 200) % 2).cast("int"))


def _two_studies_roads(spark, sf):
    return _in_two(fx.roads(spark, sf), F.element_at("geom", 1)["y"])


def _two_studies_crashes(spark, sf):
    """Even and odd rows of all crashes; those of the second study happened three years earlier."""
    crashes = _in_two(fx.crashes(spark, sf), F.col("y"))
    return crashes.withColumn("crash_year", F.col("crash_year") - F.when(F.col("study_id") == 2, 3).otherwise(0))


@query(
    "top_corridors_own_count",
    f"""WITH {SCREENING}, best AS (SELECT cast(1 + cast(start_y / 200 AS int) % 2 AS int) AS study_id, road_name, functional_class,
      max(ped_crash_score) AS crash_score FROM scored WHERE ped_crash_score > 0 GROUP BY 1, 2, 3)
    SELECT study_id, cast(row_number() OVER (PARTITION BY study_id ORDER BY crash_score DESC) AS int) AS rank, crash_score FROM best
    QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY crash_score DESC) <= CASE study_id WHEN 1 THEN 10 ELSE 17 END""",
)
def top_corridors_own_count(spark, sf):
    """Two studies: the first has the usual number of corridors, the second its own."""
    r = swa.run_swa(_two_studies_roads(spark, sf), _two_studies_crashes(spark, sf), swa.SwaParams())
    studies = spark.range(1, 3).select(F.col("id").cast("int").alias("study_id"), F.when(F.col("id") == 2, 17).alias("top_streets_threshold"))
    return ranking.top_corridors(r.sliding, "ped", studies=studies).select("study_id", "rank", "crash_score")


@query(
    "multi_study_scores",
    f"""WITH {SCREENING} SELECT cast(1 + cast(start_y / 200 AS int) % 2 AS int) AS study_id, functional_class,
      cast(sum(ped_k) AS bigint) AS ped_k, cast(sum(mv_crash_score) AS bigint) AS mv_crash_score FROM scored GROUP BY 1, 2""",
)
def multi_study_scores(spark, sf):
    """Two studies in one job: even and odd rows of roads, each with all of its crashes and its own latest year."""
    r = swa.run_swa(_two_studies_roads(spark, sf), _two_studies_crashes(spark, sf), swa.SwaParams())
    return r.sliding.groupBy("study_id", "functional_class").agg(
        F.sum("ped_k").alias("ped_k"), F.sum("mv_crash_score").alias("mv_crash_score")
    )


_OWN = {"K": 10, "A": 5, "B": 2, "C": 1, "O": 0}


def _own_params_sql():
    """The analysis once per study, each with its own parameters."""
    parts = []
    for study, (mi, ratio, feet, weights) in enumerate([(0.5, 5, 50, d.CRASH_WEIGHTS), (0.25, 2, 100, _OWN)], 1):
        window = mi * d.METERS_PER_MILE
        ctes = f"{CHAINS}, {sliding_sql(window, window / ratio)}, {STUDY_CRASHES}, {counted_sql(feet * d.METERS_PER_FOOT, weights)}"
        parts.append(
            f"""SELECT * FROM (WITH {ctes} SELECT cast({study} AS int) AS study_id, functional_class, count(*) AS windows,
            cast(sum(ped_k) AS bigint) AS ped_k, cast(sum(mv_crash_score) AS bigint) AS mv_crash_score FROM scored
            WHERE 1 + cast(start_y / 200 AS int) % 2 = {study} GROUP BY functional_class) s{study}"""
        )
    return " UNION ALL ".join(parts)


@query("multi_study_own_params", _own_params_sql())
def multi_study_own_params(spark, sf):
    """Two studies in one job, each with its own windows, join distance, weights and latest year."""
    own = F.create_map(*[x for s, w in _OWN.items() for x in (F.lit(s), F.lit(w))])
    studies = spark.range(1, 3).select(
        F.col("id").cast("int").alias("study_id"),
        F.when(F.col("id") == 2, 0.25).alias("sliding_window_length"),
        F.when(F.col("id") == 2, 2).alias("window_length_ratio"),
        F.when(F.col("id") == 2, 100).alias("crash_join_distance"),
        F.when(F.col("id") == 2, own).alias("crash_weights"),
    )
    r = swa.run_swa(_two_studies_roads(spark, sf), _two_studies_crashes(spark, sf), study_params(studies))
    return r.sliding.groupBy("study_id", "functional_class").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("ped_k").alias("ped_k"), F.sum("mv_crash_score").alias("mv_crash_score")
    )


_SHOWN = " OR ".join(f"{c} > 0" for c in d.SCORE_COLUMNS)


@query(
    "swa_view",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES}
    SELECT {initcap('road_name')} AS road_name, functional_class, start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(d.SCORE_COLUMNS)}, {", ".join(f"{d.score_column(m)} > 0 AS show_{m}" for m in d.MODES)}
    FROM short_scores WHERE {_SHOWN}""",
)
def swa_view(spark, sf):
    _, _, short = screening(spark, sf)
    v = views.swa_view(short)
    return v.select(*LINE, "segment_sequence", *d.SCORE_COLUMNS, *[f"show_{m}" for m in d.MODES])


@query(
    "merge_equal_scores",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES},
    shown AS (SELECT s.*, w.exact_start, w.exact_end, s.start_x + w.exact_start AS px0, s.start_x + w.exact_end AS px1
              FROM short_scores s JOIN short_windows w USING (start_x, start_y, segment_sequence) WHERE {_SHOWN}),
    b AS (SELECT *, CASE WHEN abs(lag(px1) OVER w - px0) < 1e-6 THEN 0 ELSE 1 END AS brk FROM shown
          WINDOW w AS (PARTITION BY road_name, functional_class, {", ".join(d.SCORE_COLUMNS)}, start_y ORDER BY px0)),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY road_name, functional_class, {", ".join(d.SCORE_COLUMNS)}, start_y ORDER BY px0
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM b)
    SELECT {initcap('road_name')} AS road_name, functional_class, {", ".join(d.SCORE_COLUMNS)},
      round(min(px0), 4) AS line_x0, start_y AS line_y0, round(max(px1) - min(px0), 4) AS line_length
    FROM i GROUP BY i.road_name, functional_class, {", ".join(d.SCORE_COLUMNS)}, start_y, isl""",
)
def merge_equal_scores(spark, sf):
    _, _, short = screening(spark, sf)
    merged = views.merge_equal_scores(edges(spark, sf), short, STEP)
    return merged.filter(F.col("seq") == 0).select(
        "road_name", "functional_class", *d.SCORE_COLUMNS, F.round("x0", 4).alias("line_x0"), F.col("y0").alias("line_y0"),
        F.round("line_length", 4).alias("line_length"),
    )


@query(
    "lrs_overlap",
    f"""WITH {CHAINS}, {SLIDING}, {SHORT}
    SELECT s.start_x, s.start_y, cast(w.segment_sequence AS int) AS segment_sequence, cast(s.window_no AS int) AS window_no,
      round(least(w.end_distance_m, s.end_distance_m) - greatest(w.start_distance_m, s.start_distance_m), 6) AS overlap
    FROM short_windows w JOIN sliding s ON s.start_x = w.start_x AND s.start_y = w.start_y
     AND w.end_distance_m > s.start_distance_m AND w.start_distance_m < s.end_distance_m""",
)
def lrs_overlap(spark, sf):
    lines = network.dissolved_lines(edges(spark, sf))
    short = lrs.short_windows(lines, STEP).select(*lrs.ROAD, "start_x", "start_y", "segment_sequence", "start_distance_m", "end_distance_m")
    slide = lrs.sliding_windows(lines, WINDOW, STEP).select(*lrs.ROAD, "window_no", "start_distance_m", "end_distance_m")
    pairs = lrs.lrs_overlap(short, slide, lrs.ROAD)
    return pairs.select("start_x", "start_y", "segment_sequence", F.col("window_no_r").alias("window_no"), _r("overlap"))


@query(
    "lrs_overlap_min_1m",
    f"""WITH {CHAINS}, {SLIDING}, {SHORT}
    SELECT s.start_x, s.start_y, cast(w.segment_sequence AS int) AS segment_sequence, count(*) AS windows
    FROM short_windows w JOIN sliding s ON s.start_x = w.start_x AND s.start_y = w.start_y
     AND least(w.end_distance_m, s.end_distance_m) - greatest(w.start_distance_m, s.start_distance_m) >= 1
    GROUP BY ALL""",
)
def lrs_overlap_min(spark, sf):
    lines = network.dissolved_lines(edges(spark, sf))
    short = lrs.short_windows(lines, STEP).select(*lrs.ROAD, "start_x", "start_y", "segment_sequence", "start_distance_m", "end_distance_m")
    slide = lrs.sliding_windows(lines, WINDOW, STEP).select(*lrs.ROAD, "start_distance_m", "end_distance_m")
    pairs = lrs.lrs_overlap(short, slide, lrs.ROAD, min_overlap=1.0, bucket=400.0)
    return pairs.groupBy("start_x", "start_y", "segment_sequence").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "study_crashes",
    f"""WITH {fx.cte('fx_crashes')} SELECT crash_id, crash_year, crash_mode, crash_severity FROM fx_crashes
    WHERE crash_severity <> 'Omit From Analysis' AND crash_mode <> 'Omit From Analysis'
      AND crash_year >= (SELECT max(crash_year) - 4 FROM fx_crashes)""",
)
def study_crashes(spark, sf):
    return swa.study_crashes(fx.crashes(spark, sf)).select("crash_id", "crash_year", "crash_mode", "crash_severity")


@query(
    "last_three_years",
    f"""WITH {fx.cte('fx_crashes')} SELECT crash_year, count(*) AS crashes FROM fx_crashes
    WHERE crash_year > (SELECT max(crash_year) - 3 FROM fx_crashes) GROUP BY crash_year""",
)
def last_three_years(spark, sf):
    return last_n_years(fx.crashes(spark, sf), 3, by=()).groupBy("crash_year").agg(F.count(F.lit(1)).alias("crashes"))


@query(
    "collapsed_points",
    f"""WITH {fx.cte('fx_crashes')} SELECT x, y, crash_mode, crash_severity, count(*) AS crashes FROM fx_crashes
    WHERE crash_mode <> 'Omit From Analysis' GROUP BY ALL""",
)
def collapsed_points(spark, sf):
    return k.collapse_points(drop_omitted(fx.crashes(spark, sf), "crash_mode")).drop("study_id")


@query(
    "any_mode_flags",
    f"""WITH {SCREENING} SELECT start_x, start_y, cast(window_no AS int) AS window_no,
    {", ".join(f"{d.score_column(m)} > 3 AS show_{m}" for m in d.MODES)} FROM scored
    WHERE {" OR ".join(f"{d.score_column(m)} > 3" for m in d.MODES)}""",
)
def any_mode_flags(spark, sf):
    _, sliding, _ = screening(spark, sf)
    return flag_modes(sliding, "crash_score", 3).select("start_x", "start_y", "window_no", *[f"show_{m}" for m in d.MODES])
