"""Queries over observed counts and the risk model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise import domain as d
from lanewise.operators import counts as k
from lanewise.operators import estimates as e
from lanewise.operators import lrs, network, ranking, summary
from lanewise.operators.cells import buffer_overlap, tile_polygons
from lanewise.operators.skew import shuffled
from lanewise.plans import model as m
from lanewise.plans import views
from lanewise.session import cut_lineage
from lanewise.sources.tables import study_params

from . import fixtures as fx
from .registry import edges, query
from .screening import _two_studies_crashes, _two_studies_roads
from .sqltext import CHAINS, FINE, FINE_SEGMENTS, JOIN, SHORT, STEP, distance, initcap, near, num, segments

STATE = "AMERICA"
KEYS = e.KEYS
PAIRS = [(mode, s) for mode in d.MODES for s in KEYS]
START = ["start_x", "start_y"]


def _r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


def _starts(spark, sf):
    return network.dissolved_lines(edges(spark, sf)).select(*lrs.ROAD, *START)


# ---------------------------------------------------------------- observed counts

NEAREST = f"""{CHAINS},
{FINE_SEGMENTS},
mapped AS (SELECT * FROM fx_crashes WHERE crash_mode IN ('ped', 'bike', 'mv') AND crash_severity IN ('K', 'A', 'B', 'C', 'O')),
hits AS (
  SELECT f.start_x, f.start_y, f.length_meters, f.segment_sequence AS fine_no, f.start_distance_m, f.end_distance_m,
         c.crash_id, c.crash_mode, c.crash_severity,
         {distance('c', 'f.start_x + f.exact_start', 'f.start_x + f.exact_end', 'f.start_y')} AS dist
  FROM fine_segments f JOIN mapped c
    ON {near('f', 'f.start_x + f.exact_start', 'f.start_x + f.exact_end', 'f.start_y')}),
nearest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY crash_id, start_x, start_y ORDER BY dist, fine_no) AS rn FROM hits) t WHERE rn = 1)"""


SMOOTHED = f"""{NEAREST},
counted AS (
  SELECT start_x, start_y, length_meters, fine_no, crash_mode, crash_severity, count(*) AS v,
         cast(ceil(length_meters / {num(FINE)}) AS int) AS n
  FROM nearest GROUP BY ALL),
weighted AS (
  SELECT *, list_sum(list_transform(generate_series(-4, 4),
            lambda o: CASE WHEN fine_no + o >= 0 AND fine_no + o < n THEN (5 - abs(o)) / 5e0 ELSE 0e0 END)) AS norm FROM counted),
smoothed AS (
  SELECT start_x, start_y, length_meters, fine_no + o AS fine_no, crash_mode, crash_severity,
         sum(v * (5 - abs(o)) / 5e0 / norm) AS v
  FROM (SELECT *, unnest(generate_series(-4, 4)) AS o FROM weighted) t
  WHERE fine_no + o >= 0 AND fine_no + o < n GROUP BY ALL)"""

_OBS_COLS = ",\n".join(
    f"coalesce(sum(CASE WHEN p.crash_mode = '{mode}' AND p.crash_severity = '{s.upper()}' THEN p.v * p.share END), 0e0) AS {mode}_{s}_obs"
    for mode, s in PAIRS
)

OBSERVED = f"""{SMOOTHED},
{SHORT},
parts AS (
  SELECT w.start_x, w.start_y, w.segment_sequence, s.crash_mode, s.crash_severity, s.v,
         (least(f.end_distance_m, w.end_distance_m) - greatest(f.start_distance_m, w.start_distance_m))
         / nullif(f.end_distance_m - f.start_distance_m, 0) AS share
  FROM smoothed s
  JOIN fine_segments f ON f.start_x = s.start_x AND f.start_y = s.start_y AND f.segment_sequence = s.fine_no
  JOIN short_windows w ON w.start_x = f.start_x AND w.start_y = f.start_y
   AND f.end_distance_m > w.start_distance_m AND f.start_distance_m < w.end_distance_m),
observed AS (
  SELECT w.start_x, w.start_y, w.segment_sequence, w.road_name, w.functional_class, w.length_meters,
         w.exact_start, w.exact_end,
         {_OBS_COLS}
  FROM short_windows w LEFT JOIN parts p
    ON p.start_x = w.start_x AND p.start_y = w.start_y AND p.segment_sequence = w.segment_sequence
  GROUP BY ALL)"""


def _mapped(spark, sf):
    c = fx.crashes(spark, sf)
    return c.filter(F.col("crash_mode").isin(d.MODES) & F.col("crash_severity").isin(d.SEVERITIES))


@query(
    "nearest_segment_per_road",
    f"""WITH {NEAREST} SELECT start_x, start_y, cast(fine_no AS int) AS fine_no, crash_mode, crash_severity,
      count(*) AS crashes, round(min(dist), 6) AS nearest FROM nearest GROUP BY ALL""",
)
def nearest_segment_per_road(spark, sf):
    n = e.nearest_segments(edges(spark, sf), _mapped(spark, sf), FINE, JOIN)
    return (
        n.join(shuffled(_starts(spark, sf)), lrs.ROAD)
        .groupBy(*START, "fine_no", "crash_mode", "crash_severity")
        .agg(F.sum("crashes").alias("crashes"), F.round(F.min("dist"), 6).alias("nearest"))
    )


@query(
    "segment_counts",
    f"""WITH {NEAREST} SELECT f.start_x, f.start_y, cast(f.segment_sequence AS int) AS segment_sequence,
      {", ".join(f"cast(count(CASE WHEN n.crash_mode = '{mode}' AND n.crash_severity = '{s.upper()}' THEN 1 END) AS int) AS {mode}_{s}" for mode, s in PAIRS)}
    FROM fine_segments f LEFT JOIN nearest n
      ON n.start_x = f.start_x AND n.start_y = f.start_y AND n.fine_no = f.segment_sequence GROUP BY ALL""",
)
def segment_counts(spark, sf):
    n = e.nearest_segments(edges(spark, sf), _mapped(spark, sf), FINE, JOIN)
    wide = k.window_counts(n.withColumnRenamed("fine_no", "segment_sequence"), [*lrs.ROAD, "segment_sequence"])
    every = lrs.short_windows(network.dissolved_lines(edges(spark, sf)), FINE)
    return k.left_fill(every, wide, e.SEGMENT, d.COUNT_COLUMNS).select(*START, "segment_sequence", *d.COUNT_COLUMNS)


@query(
    "smooth_along",
    f"""WITH {SMOOTHED} SELECT start_x, start_y, cast(fine_no AS int) AS fine_no, crash_mode, crash_severity,
      round(v, 6) AS crashes FROM smoothed""",
)
def smooth_along(spark, sf):
    n = e.nearest_segments(edges(spark, sf), _mapped(spark, sf), FINE, JOIN)
    counted = k.segment_counts(n, [*lrs.ROAD, "length_meters", "fine_no"], "crashes")
    s = k.smooth_along(
        counted.withColumn("n", lrs.step_count("length_meters", FINE)), ["crashes"], [*lrs.ROAD], "fine_no",
        count="n", extra_keys=["crash_mode", "crash_severity"],
    )
    return s.join(shuffled(_starts(spark, sf)), lrs.ROAD).select(*START, "fine_no", "crash_mode", "crash_severity", _r("crashes"))


@query(
    "proportional_sum",
    f"""WITH {CHAINS}, {FINE_SEGMENTS}, {SHORT}
    SELECT w.start_x, w.start_y, cast(w.segment_sequence AS int) AS segment_sequence,
      round(sum((f.segment_sequence + 1) * (least(f.end_distance_m, w.end_distance_m) - greatest(f.start_distance_m, w.start_distance_m))
          / nullif(f.end_distance_m - f.start_distance_m, 0)), 6) AS weight
    FROM fine_segments f JOIN short_windows w ON w.start_x = f.start_x AND w.start_y = f.start_y
     AND f.end_distance_m > w.start_distance_m AND f.start_distance_m < w.end_distance_m GROUP BY ALL""",
)
def proportional_sum(spark, sf):
    lines = network.dissolved_lines(edges(spark, sf))
    cols = [*lrs.ROAD, "segment_sequence", "start_distance_m", "end_distance_m"]
    fine = lrs.short_windows(lines, FINE).select(*cols).withColumn("weight", F.col("segment_sequence") + 1.0)
    short = lrs.short_windows(lines, STEP).select(*cols, *START)
    pairs = lrs.lrs_overlap(fine, short, lrs.ROAD)
    return k.proportional_sum(pairs, ["weight"], ["start_x_r", "start_y_r", "segment_sequence_r"]).select(
        F.col("start_x_r").alias("start_x"), F.col("start_y_r").alias("start_y"),
        F.col("segment_sequence_r").alias("segment_sequence"), _r("weight"),
    )


@query(
    "observed_counts",
    f"""WITH {OBSERVED} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round({mode}_{s}_obs, 6) AS {mode}_{s}_obs" for mode, s in PAIRS)} FROM observed""",
)
def observed_counts(spark, sf):
    obs = e.observed_counts(edges(spark, sf), _mapped(spark, sf), STEP, FINE, JOIN)
    every = lrs.short_windows(network.dissolved_lines(edges(spark, sf)), STEP)
    cols = [f"{mode}_{s}_obs" for mode, s in PAIRS]
    return k.left_fill(every, obs, e.SEGMENT, cols, 0.0).select(*START, "segment_sequence", *[_r(c) for c in cols])


@query(
    "observed_all_modes",
    f"""WITH {OBSERVED} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      round(ped_k_obs + bike_k_obs + mv_k_obs + ped_a_obs + bike_a_obs + mv_a_obs, 6) AS all_fsi_obs,
      round(ped_k_obs + bike_k_obs, 6) AS vru_k_obs FROM observed
      WHERE ped_k_obs + bike_k_obs + mv_k_obs + ped_a_obs + bike_a_obs + mv_a_obs
          + ped_b_obs + bike_b_obs + mv_b_obs + ped_c_obs + bike_c_obs + mv_c_obs + ped_o_obs + bike_o_obs + mv_o_obs > 0""",
)
def observed_all_modes(spark, sf):
    """Roll-up through mapping lists: one source mode may feed several output modes."""
    obs = e.observed_counts(
        edges(spark, sf), _mapped(spark, sf), STEP, FINE, JOIN,
        modes={"all": d.MODES, "vru": ["ped", "bike"]}, severities={"k": "K", "a": "A"},
    )
    return obs.join(shuffled(_starts(spark, sf)), lrs.ROAD).select(
        *START, "segment_sequence", F.round(F.col("all_k_obs") + F.col("all_a_obs"), 6).alias("all_fsi_obs"), _r("vru_k_obs")
    )


# ---------------------------------------------------------------- estimates

_W = num(d.ROAD_BUFFER_M)
PIECES = f"""{fx.cte('fx_block_groups', 'fx_rates', 'fx_ratios')},
pieces AS (
  SELECT *, (exact_end - exact_start) / 1609.34e0 * piece_area / sum(piece_area) OVER (PARTITION BY start_x, start_y, segment_sequence)
            AS effective_mileage
  FROM (SELECT w.start_x, w.start_y, w.segment_sequence, w.functional_class, w.exact_start, w.exact_end, b.geoid,
               b.final_pred_ped, b.final_se_ped, b.final_pred_bike, b.final_se_bike, b.final_pred_mv, b.final_se_mv,
               greatest(least(w.start_x + w.exact_end, b.bx1) - greatest(w.start_x + w.exact_start, b.bx0), 0e0)
             * greatest(least(w.start_y + {_W}, b.by1) - greatest(w.start_y - {_W}, b.by0), 0e0) AS piece_area
        FROM short_windows w JOIN fx_block_groups b
          ON w.start_x + w.exact_end >= b.bx0 AND w.start_x + w.exact_start <= b.bx1
         AND w.start_y + {_W} >= b.by0 AND w.start_y - {_W} <= b.by1) t
  WHERE piece_area > 0)"""

INITIAL = f"""{PIECES},
initial AS (
  SELECT p.*, {", ".join(f"p.effective_mileage * r.{mode}_fatal_rate * 5 AS init_{mode}_k" for mode in d.MODES)}
  FROM pieces p LEFT JOIN fx_rates r ON r.state = '{STATE}' AND r.functional_class = p.functional_class)"""


def _est(mode):
    total = f"coalesce(sum(init_{mode}_k) OVER (PARTITION BY geoid), 0)"
    return f"""init_{mode}_k * CASE WHEN {total} = 0 THEN 0e0 ELSE final_pred_{mode} / {total} END AS est_{mode}_k,
      CASE WHEN final_pred_{mode} <> 0 THEN final_se_{mode} / final_pred_{mode}
           WHEN final_se_{mode} <> 0 THEN cast('infinity' AS double) END AS cv_{mode}"""


SCALED = f"""{INITIAL},
scaled AS (SELECT *, {", ".join(_est(mode) for mode in d.MODES)} FROM initial)"""

ROLLED = f"""{SCALED},
rolled AS (
  SELECT start_x, start_y, segment_sequence,
    {", ".join(f"coalesce(sum(est_{mode}_k), 0) AS est_{mode}_k, coalesce(sum(cv_{mode} * effective_mileage), 0) / sum(effective_mileage) AS {mode}_cv" for mode in d.MODES)}
  FROM scaled GROUP BY ALL)"""

_RATIO = ", ".join(f"max(CASE WHEN mode = '{mode}' AND severity = '{s}' THEN ratio END) AS r_{mode}_{s}" for mode, s in PAIRS)
EXPANDED = f"""{ROLLED},
ratio AS (SELECT {_RATIO} FROM fx_ratios WHERE state = '{STATE}'),
expanded AS (
  SELECT w.start_x, w.start_y, w.segment_sequence, {", ".join(f"f.{mode}_cv" for mode in d.MODES)},
    {", ".join(f"f.est_{mode}_k * q.r_{mode}_{s} AS est_{mode}_{s}" for mode, s in PAIRS)}
  FROM short_windows w LEFT JOIN rolled f USING (start_x, start_y, segment_sequence) CROSS JOIN ratio q)"""


def _post(mode, s):
    w = f"(0.8e0 / (1 + x.{mode}_cv * x.est_{mode}_{s}))"
    ok = f"NOT isnan(x.{mode}_cv * x.est_{mode}_{s})"
    return f"""CASE WHEN {ok} THEN {w} END AS w_{mode}_{s},
    CASE WHEN {ok} THEN {w} * x.est_{mode}_{s} + (1 - {w}) * o.{mode}_{s}_obs END AS adj_{mode}_{s}"""


def _cost(mode):
    return " + ".join(f"adj_{mode}_{s} * {d.CRASH_COSTS[s.upper()]}" for s in KEYS)


POSTERIOR = f"""{OBSERVED},
{EXPANDED},
updated AS (
  SELECT o.*, x.* EXCLUDE (start_x, start_y, segment_sequence), {", ".join(_post(mode, s) for mode, s in PAIRS)}
  FROM observed o JOIN expanded x USING (start_x, start_y, segment_sequence)),
posterior AS (SELECT *, {", ".join(f"{_cost(mode)} AS total_{mode}_cost" for mode in d.MODES)} FROM updated)"""

ESTIMATES = f"{CHAINS}, {SHORT}, "


def _ratios(spark, sf):
    """Wide ratio table, one row per state."""
    cols = [
        F.max(F.when((F.col("mode") == mode) & (F.col("severity") == s), F.col("ratio"))).alias(f"{mode}_{s}")
        for mode, s in PAIRS
    ]
    return fx.ratios(spark, sf).groupBy("state").agg(*cols)


def _store(spark, sf):
    return m.ModelStore(
        edges(spark, sf), fx.crashes(spark, sf), fx.block_groups(spark, sf), fx.rates(spark, sf), _ratios(spark, sf)
    )


PARAMS = m.ModelParams(state=STATE)


def _run(spark, sf, upto):
    s = _store(spark, sf)
    for step in m.STEPS:
        s = step(s, PARAMS)
        if step is upto:
            break
    return s


@query(
    "buffer_overlap",
    f"""WITH {fx.cte('fx_roads', 'fx_block_groups')} SELECT r.road_id, b.geoid,
      round((least(r.x1, b.bx1) - greatest(r.x0, b.bx0)) * (least(r.y0 + {_W}, b.by1) - greatest(r.y0 - {_W}, b.by0)), 4) AS piece_area
    FROM fx_roads r JOIN fx_block_groups b
      ON r.x1 > b.bx0 AND r.x0 < b.bx1 AND r.y0 + {_W} > b.by0 AND r.y0 - {_W} < b.by1""",
)
def buffer_overlap_q(spark, sf):
    tiles = tile_polygons(fx.block_groups(spark, sf).select("study_id", "geoid", "rings"))
    e_ = network.line_edges(fx.roads(spark, sf).select("study_id", "road_id", "geom"))
    return buffer_overlap(e_, tiles, ["road_id"], "geoid", d.ROAD_BUFFER_M).select("road_id", "geoid", _r("piece_area", 4))


@query(
    "effective_mileage",
    f"""WITH {ESTIMATES}{PIECES} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence, geoid,
      functional_class, round(piece_area, 4) AS piece_area, round(effective_mileage, 8) AS effective_mileage FROM pieces""",
)
def effective_mileage(spark, sf):
    p = _run(spark, sf, m.assign_mileage).pieces
    return p.join(shuffled(_starts(spark, sf)), lrs.ROAD).select(
        *START, "segment_sequence", "geoid", "functional_class", _r("piece_area", 4), _r("effective_mileage", 8)
    )


@query(
    "initial_fatal",
    f"""WITH {ESTIMATES}{INITIAL} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence, geoid,
      {", ".join(f"round(init_{mode}_k, 9) AS init_{mode}_k" for mode in d.MODES)} FROM initial""",
)
def initial_fatal(spark, sf):
    p = e.initial_fatal(_run(spark, sf, m.assign_mileage).pieces, fx.rates(spark, sf), STATE)
    return p.join(shuffled(_starts(spark, sf)), lrs.ROAD).select(
        *START, "segment_sequence", "geoid", *[_r(f"init_{mode}_k", 9) for mode in d.MODES]
    )


@query(
    "scaled_fatal",
    f"""WITH {ESTIMATES}{SCALED} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence, geoid,
      {", ".join(f"round(est_{mode}_k, 8) AS est_{mode}_k" for mode in d.MODES)} FROM scaled""",
)
def scaled_fatal(spark, sf):
    p = _run(spark, sf, m.estimate_fatal).pieces
    return p.join(shuffled(_starts(spark, sf)), lrs.ROAD).select(
        *START, "segment_sequence", "geoid", *[_r(f"est_{mode}_k", 8) for mode in d.MODES]
    )


def _finite_sql(col, alias, digits):
    return f"CASE WHEN isinf({col}) THEN -1e0 ELSE round({col}, {digits}) END AS {alias}"


def _finite(col, digits):
    c = F.col(col)
    return F.when(c == float("inf"), F.lit(-1.0)).otherwise(F.round(c, digits)).alias(col)


@query(
    "segment_fatal",
    f"""WITH {ESTIMATES}{ROLLED} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round(est_{mode}_k, 8) AS est_{mode}_k, {_finite_sql(f'{mode}_cv', f'{mode}_cv', 6)}" for mode in d.MODES)} FROM short_windows LEFT JOIN rolled USING (start_x, start_y, segment_sequence)""",
)
def segment_fatal(spark, sf):
    s = _run(spark, sf, m.estimate_fatal)
    f = s.fatal.join(shuffled(_starts(spark, sf)), lrs.ROAD)
    cols = [c for mode in d.MODES for c in (_r(f"est_{mode}_k", 8), _finite(f"{mode}_cv", 6))]
    return f.select(*START, "segment_sequence", *cols)


@query(
    "expand_severity",
    f"""WITH {ESTIMATES}{EXPANDED} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round(est_{mode}_{s}, 6) AS est_{mode}_{s}" for mode, s in PAIRS)} FROM expanded""",
)
def expand_severity(spark, sf):
    s = _run(spark, sf, m.estimate_severities)
    f = s.all_severity.join(shuffled(_starts(spark, sf)), lrs.ROAD)
    return f.select(*START, "segment_sequence", *[_r(f"est_{mode}_{x}") for mode, x in PAIRS])


@query(
    "eb_update",
    f"""WITH {POSTERIOR} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round(w_{mode}_{s}, 6) AS w_{mode}_{s}, round(adj_{mode}_{s}, 5) AS adj_{mode}_{s}" for mode, s in PAIRS)} FROM posterior""",
)
def eb_update(spark, sf):
    p = _run(spark, sf, m.blend).posterior.join(shuffled(_starts(spark, sf)), lrs.ROAD)
    cols = [c for mode, s in PAIRS for c in (_r(f"w_{mode}_{s}"), _r(f"adj_{mode}_{s}", 5))]
    return p.select(*START, "segment_sequence", *cols)


@query(
    "crash_costs",
    f"""WITH {POSTERIOR} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round(total_{mode}_cost, 1) AS total_{mode}_cost" for mode in d.MODES)} FROM posterior""",
)
def crash_costs(spark, sf):
    p = _run(spark, sf, m.blend).posterior.join(shuffled(_starts(spark, sf)), lrs.ROAD)
    return p.select(*START, "segment_sequence", *[_r(f"total_{mode}_cost", 1) for mode in d.MODES])


@query(
    "fatal_only_update",
    f"""WITH {POSTERIOR} SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"round(adj_{mode}_k * {d.CRASH_COSTS['K']}, 1) AS total_{mode}_cost" for mode in d.MODES)} FROM posterior""",
)
def fatal_only_update(spark, sf):
    """Posterior and cost when the crash source has fatal crashes only."""
    s = m.run_model(_store(spark, sf), m.ModelParams(state=STATE, fatal_only=True))
    p = s.posterior.join(shuffled(_starts(spark, sf)), lrs.ROAD)
    return p.select(*START, "segment_sequence", *[_r(f"total_{mode}_cost", 1) for mode in d.MODES])


@query(
    "run_model",
    f"""WITH {POSTERIOR} SELECT functional_class, count(*) AS windows,
      {", ".join(f"round(sum(est_{mode}_{s}), 4) AS est_{mode}_{s}, round(sum({mode}_{s}_obs), 4) AS {mode}_{s}_obs, round(sum(adj_{mode}_{s}), 4) AS adj_{mode}_{s}" for mode, s in PAIRS)}
    FROM posterior GROUP BY functional_class""",
)
def run_model(spark, sf):
    """All steps of the risk model, added up by class."""
    out = m.model_output(m.run_model(_store(spark, sf), PARAMS))
    aggs = [F.round(F.sum(c), 4).alias(c) for mode, s in PAIRS for c in (f"est_{mode}_{s}", f"{mode}_{s}_obs", f"adj_{mode}_{s}")]
    return out.groupBy("functional_class").agg(F.count(F.lit(1)).alias("windows"), *aggs)


@query(
    "observed_vs_adjusted_ped",
    f"""WITH {POSTERIOR}, t AS (SELECT {", ".join(f"sum(coalesce(ped_{s}_obs, 0)) AS o_{s}, sum(coalesce(adj_ped_{s}, 0)) AS a_{s}" for s in KEYS)} FROM posterior)
    {" UNION ALL ".join(f"SELECT '{s.upper()}' AS severity, '{d.SEVERITY_LABELS[s.upper()]}' AS label, round(o_{s}, 4) AS observed, round(a_{s}, 4) AS adjusted FROM t" for s in KEYS)}""",
)
def observed_vs_adjusted(spark, sf):
    r = summary.observed_vs_adjusted(_run(spark, sf, m.blend).posterior, "ped")
    return r.select("severity", "label", _r("observed", 4), _r("adjusted", 4))


_COST_SHOWN = " OR ".join(f"coalesce(total_{mode}_cost, 0) > 18100" for mode in d.MODES)


@query(
    "cost_view",
    f"""WITH {POSTERIOR} SELECT {initcap('road_name')} AS road_name, functional_class, start_x, start_y,
      cast(segment_sequence AS int) AS segment_sequence,
      {", ".join(f"cast(round_even(round(total_{mode}_cost, 4), 0) AS int) AS {mode}_cost, coalesce(total_{mode}_cost, 0) > 18100 AS show_{mode}" for mode in d.MODES)}
    FROM posterior WHERE {_COST_SHOWN}""",
)
def cost_view(spark, sf):
    v = views.cost_view(_run(spark, sf, m.blend).posterior).join(shuffled(_starts(spark, sf)), lrs.ROAD)
    return v.select(
        "road_name", "functional_class", *START, "segment_sequence",
        *[c for mode in d.MODES for c in (f"{mode}_cost", f"show_{mode}")],
    )


@query(
    "top_segments_mv",
    f"""WITH {POSTERIOR} SELECT {initcap('road_name')} AS road_name, functional_class,
      cast(round_even(total_mv_cost, 0) AS int) AS mv_cost FROM posterior
    WHERE total_mv_cost > 18100 ORDER BY total_mv_cost DESC LIMIT 10""",
)
def top_segments(spark, sf):
    v = views.cost_view(_run(spark, sf, m.blend).posterior)
    return ranking.top_segments(v, "mv").select("road_name", "functional_class", "mv_cost")


def _two_states_sql():
    parts = []
    for study, state in ((1, "AMERICA"), (2, "ASIA")):
        ctes = f"{ESTIMATES}{EXPANDED}".replace(
            "FROM fx_roads WHERE functional_class <> 'Omit From Analysis'",
            f"FROM fx_roads WHERE functional_class <> 'Omit From Analysis' AND 1 + cast(y0 / 200 AS int) % 2 = {study}",
        ).replace(f"'{STATE}'", f"'{state}'")
        parts.append(
            f"""SELECT * FROM (WITH {ctes} SELECT cast({study} AS int) AS study_id, count(*) AS windows,
            {", ".join(f"round(sum(est_{mode}_{s}), 4) AS est_{mode}_{s}" for mode, s in PAIRS)} FROM expanded) s{study}"""
        )
    return " UNION ALL ".join(parts)


@query("multi_study_estimates", _two_states_sql())
def multi_study_estimates(spark, sf):
    """Estimates of two studies in two states, from one job."""
    study = (1 + F.floor(F.element_at("geom", 1)["y"] / 200) % 2).cast("int")
    stitched = network.dissolve_roads(fx.roads(spark, sf).withColumn("study_id", study))
    both = fx.block_groups(spark, sf).withColumn("study_id", F.explode(F.array(F.lit(1), F.lit(2))))
    states = spark.range(1, 3).select(
        F.col("id").cast("int").alias("study_id"), F.when(F.col("id") == 1, "AMERICA").otherwise("ASIA").alias("state")
    )
    store = m.ModelStore(stitched, fx.crashes(spark, sf), both, fx.rates(spark, sf), _ratios(spark, sf), states)
    for step in (m.build_windows, m.assign_mileage, m.estimate_fatal, m.estimate_severities):
        store = step(store, m.ModelParams())
    sums = [F.round(F.sum(f"est_{mode}_{s}"), 4).alias(f"est_{mode}_{s}") for mode, s in PAIRS]
    return store.all_severity.groupBy("study_id").agg(F.count(F.lit(1)).alias("windows"), *sums)


_OWN = {"window": 0.25, "ratio": 2, "feet": 100, "top": 0.6, "decay": 2, "costs": {"K": 9000000, "A": 800000, "B": 250000, "C": 90000, "O": 9000}}
_USUAL = {
    "window": d.SLIDING_WINDOW_MI, "ratio": d.WINDOW_RATIO, "feet": d.JOIN_DISTANCE_FT,
    "top": d.MAX_PRIOR_WEIGHT, "decay": d.PRIOR_DECAY, "costs": d.CRASH_COSTS,
}


def _swap(text, *pairs):
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"not in the SQL: {old}")
        text = text.replace(old, new)
    return text


def _study_model_sql(study, state, p, fatal_only):
    """The whole model over one study's roads and crashes, with its own parameters."""
    span = ("f", "f.start_x + f.exact_start", "f.start_x + f.exact_end", "f.start_y")
    severity = "'K'" if fatal_only else "crash_severity"
    text = _swap(
        f"{OBSERVED},\n{EXPANDED}",
        ("FROM fx_roads WHERE functional_class <> 'Omit From Analysis'",
         f"FROM fx_roads WHERE functional_class <> 'Omit From Analysis' AND 1 + cast(y0 / 200 AS int) % 2 = {study}"),
        ("mapped AS (SELECT * FROM fx_crashes WHERE",
         f"""own AS (SELECT * REPLACE ({severity} AS crash_severity) FROM fx_crashes WHERE 1 + cast(floor(y / 200) AS int) % 2 = {study}),
mapped AS (SELECT * FROM own WHERE crash_year > (SELECT max(crash_year) - 5 FROM own) AND"""),
        (near(*span), near(*span, "c", p["feet"] * d.METERS_PER_FOOT)),
        (SHORT, segments("short_windows", p["window"] * d.METERS_PER_MILE / p["ratio"])),
        (f"'{STATE}'", f"'{state}'"),
    )
    counted = KEYS[:1] if fatal_only else KEYS
    adjusted = []
    for mode, s in PAIRS:
        x, w = f"x.{mode}_cv * x.est_{mode}_{s}", f"({num(p['top'])} / pow(1 + x.{mode}_cv * x.est_{mode}_{s}, {num(p['decay'])}))"
        value = f"CASE WHEN NOT isnan({x}) THEN {w} * x.est_{mode}_{s} + (1 - {w}) * o.{mode}_{s}_obs END"
        adjusted.append(f"{value if s in counted else 'cast(NULL AS double)'} AS adj_{mode}_{s}")
    cost = {mode: " + ".join(f"adj_{mode}_{s} * {p['costs'][s.upper()]}" for s in counted) for mode in d.MODES}
    shown = " OR ".join(f"coalesce(total_{mode}_cost, 0) > {p['costs']['O']}" for mode in d.MODES)
    return f"""SELECT * FROM (WITH {text},
updated AS (
  SELECT o.*, x.* EXCLUDE (start_x, start_y, segment_sequence), {", ".join(adjusted)}
  FROM observed o JOIN expanded x USING (start_x, start_y, segment_sequence)),
priced AS (SELECT *, {", ".join(f"{cost[mode]} AS total_{mode}_cost" for mode in d.MODES)} FROM updated)
SELECT cast({study} AS int) AS study_id, functional_class, count(*) AS windows,
  {", ".join(f"round(sum(est_{mode}_{s}), 4) AS est_{mode}_{s}, round(sum({mode}_{s}_obs), 4) AS {mode}_{s}_obs, round(sum(adj_{mode}_{s}), 4) AS adj_{mode}_{s}" for mode, s in PAIRS)},
  {", ".join(f"round(sum(total_{mode}_cost), 0) AS {mode}_cost" for mode in d.MODES)},
  count(CASE WHEN {shown} THEN 1 END) AS shown
FROM priced GROUP BY functional_class) s{study}"""


@query(
    "multi_study_model",
    f"{_study_model_sql(1, STATE, _USUAL, False)} UNION ALL {_study_model_sql(2, 'ASIA', _OWN, True)}",
)
def multi_study_model(spark, sf):
    """The model over two studies in one job, through costs and shown segments, the second with parameters of its own.

    Its windows, distance, weight, decay, costs, state and latest year differ, and all of its crashes are fatal.
    """
    roads, crashes = _two_studies_roads(spark, sf), _two_studies_crashes(spark, sf)
    crashes = crashes.withColumn("crash_severity", F.when(F.col("study_id") == 2, "K").otherwise(F.col("crash_severity")))
    second, costs = F.col("id") == 2, F.create_map(*[x for s, c in _OWN["costs"].items() for x in (F.lit(s), F.lit(c))])
    own = {
        "sliding_window_length": "window", "window_length_ratio": "ratio", "crash_join_distance": "feet",
        "bayesian_max_prior_weight": "top", "bayesian_decay": "decay",
    }
    studies = spark.range(1, 3).select(
        F.col("id").cast("int").alias("study_id"),
        *[F.when(second, F.lit(_OWN[key])).alias(name) for name, key in own.items()],
        F.when(second, costs).alias("crash_costs"),
    )
    states = studies.select("study_id", F.when(F.col("study_id") == 2, "ASIA").otherwise(STATE).alias("state"))
    both = fx.block_groups(spark, sf).withColumn("study_id", F.explode(F.array(F.lit(1), F.lit(2))))
    store = m.ModelStore(
        cut_lineage(network.dissolve_roads(roads)), crashes, both, fx.rates(spark, sf), _ratios(spark, sf), states, study_params(studies)
    )
    posterior = m.run_model(store, m.ModelParams(years=5)).posterior
    sums = [F.round(F.sum(c), 4).alias(c) for mode, s in PAIRS for c in (f"est_{mode}_{s}", f"{mode}_{s}_obs", f"adj_{mode}_{s}")]
    prices = [F.round(F.sum(f"total_{mode}_cost"), 0).alias(f"{mode}_cost") for mode in d.MODES]
    line = ["study_id", "functional_class"]
    shown = views.cost_view(posterior, F.col("crash_costs")["O"]).groupBy(*line).agg(F.count(F.lit(1)).alias("shown"))
    sums = posterior.groupBy(*line).agg(F.count(F.lit(1)).alias("windows"), *sums, *prices)
    return k.left_fill(sums, shown, line, ["shown"], 0)
