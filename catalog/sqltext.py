"""Check SQL shared by several queries: straight roads make every geometry one interval."""

from __future__ import annotations

from lanewise import domain as d

from .fixtures import cte


def num(value: float) -> str:
    """Literal that DuckDB reads as DOUBLE."""
    return f"{float(value)!r}e0" if "e" not in repr(float(value)) else repr(float(value))


WINDOW = d.SLIDING_WINDOW_MI * d.METERS_PER_MILE
STEP = WINDOW / d.WINDOW_RATIO
FINE = d.FINE_SEGMENT_MI * d.METERS_PER_MILE
JOIN = d.JOIN_DISTANCE_FT * d.METERS_PER_FOOT

CHAINS = f"""{cte('fx_roads', 'fx_crashes')},
kept_roads AS (SELECT * FROM fx_roads WHERE functional_class <> 'Omit From Analysis'),
breaks AS (
  SELECT *, CASE WHEN lag(x1) OVER w = x0 THEN 0 ELSE 1 END AS brk FROM kept_roads
  WINDOW w AS (PARTITION BY road_name, functional_class, y0 ORDER BY x0)),
islands AS (
  SELECT *, sum(brk) OVER (PARTITION BY road_name, functional_class, y0 ORDER BY x0
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM breaks),
chains AS (
  SELECT lower(road_name) AS road_name, functional_class, min(x0) AS start_x, y0 AS start_y,
         max(x1) - min(x0) AS length_meters
  FROM islands GROUP BY islands.road_name, functional_class, y0, isl)"""

def sliding_sql(window: float, step: float) -> str:
    return f"""sliding AS (
  SELECT *, {num(step)} * window_no AS start_distance_m,
         least({num(window)} + {num(step)} * window_no, length_meters) AS end_distance_m
  FROM (SELECT *, unnest(generate_series(0, num_windows - 1)) AS window_no
        FROM (SELECT *, CASE WHEN length_meters <= {num(window)} THEN 1
                        ELSE cast(ceil((length_meters - {num(window)}) / {num(step)}) AS int) + 1 END AS num_windows
              FROM chains) t) u)"""


SLIDING = sliding_sql(WINDOW, STEP)

STUDY_CRASHES = """study_crashes AS (
  SELECT * FROM fx_crashes WHERE crash_severity <> 'Omit From Analysis' AND crash_mode <> 'Omit From Analysis'
     AND crash_year >= (SELECT max(crash_year) - 4 FROM fx_crashes))"""


def segments(name: str, step: float) -> str:
    tenth = "round(cast({} AS decimal(28,10)), 1)"
    start = tenth.format(f"{num(step)} * segment_sequence")
    end = tenth.format(f"least({num(step)} * (segment_sequence + 1), length_meters)")
    return f"""{name} AS (
  SELECT *, cast({start} AS double) AS start_distance_m, cast({end} AS double) AS end_distance_m,
         {num(step)} * segment_sequence AS exact_start, least({num(step)} * (segment_sequence + 1), length_meters) AS exact_end
  FROM (SELECT *, unnest(generate_series(0, cast(ceil(length_meters / {num(step)}) AS int) - 1)) AS segment_sequence
        FROM chains) t
  WHERE {num(step)} * segment_sequence / length_meters < 1)"""


SHORT = segments("short_windows", STEP)
FINE_SEGMENTS = segments("fine_segments", FINE)


def near(line: str, x0: str, x1: str, y: str, crash: str = "c", d_m: float = JOIN) -> str:
    """Join condition: point within the distance of a horizontal stretch."""
    r = num(d_m)
    dist = distance(crash, x0, x1, y)
    return (
        f"{crash}.y >= {y} - {r} AND {crash}.y <= {y} + {r} AND {crash}.x >= {x0} - {r} AND {crash}.x <= {x1} + {r} "
        f"AND {dist} <= {r}"
    )


def distance(crash: str, x0: str, x1: str, y: str) -> str:
    dx = f"greatest({x0} - {crash}.x, {crash}.x - ({x1}), 0e0)"
    return f"sqrt({dx} * {dx} + ({crash}.y - {y}) * ({crash}.y - {y}))"


def count_cols() -> str:
    return ",\n         ".join(
        f"cast(count(CASE WHEN c.crash_mode = '{m}' AND c.crash_severity = '{s}' THEN 1 END) AS int) AS {d.count_column(m, s)}"
        for m, s in d.MODE_SEVERITY
    )


def score_cols(weights: dict) -> str:
    parts = []
    for m in d.MODES:
        terms = " + ".join(f"{d.count_column(m, s)} * {weights[s]}" for s in d.SEVERITIES)
        parts.append(f"cast({terms} AS int) AS {d.score_column(m)}")
    return ",\n         ".join(parts)


def counted_sql(join_m: float, weights: dict) -> str:
    return f"""counted AS (
  SELECT s.road_name, s.functional_class, s.start_x, s.start_y, s.length_meters, s.window_no,
         s.start_distance_m, s.end_distance_m,
         {count_cols()}
  FROM sliding s LEFT JOIN study_crashes c
    ON {near('s', 's.start_x + s.start_distance_m', 's.start_x + s.end_distance_m', 's.start_y', 'c', join_m)}
  GROUP BY ALL),
scored AS (
  SELECT *, {score_cols(weights)} FROM counted)"""


COUNTED = counted_sql(JOIN, d.CRASH_WEIGHTS)

SCREENING = f"""{CHAINS},
{SLIDING},
{STUDY_CRASHES},
{COUNTED}"""

SHORT_SCORES = f"""short_scores AS (
  SELECT w.road_name, w.functional_class, w.start_x, w.start_y, w.segment_sequence, w.start_distance_m, w.end_distance_m,
         {", ".join(f"coalesce(max(s.{c}), 0) AS {c}" for c in d.SCORE_COLUMNS)}
  FROM short_windows w LEFT JOIN scored s
    ON s.start_x = w.start_x AND s.start_y = w.start_y
   AND least(w.end_distance_m, s.end_distance_m) - greatest(w.start_distance_m, s.start_distance_m) >= 1
  GROUP BY ALL)"""


def initcap(col: str) -> str:
    return f"upper(substr({col}, 1, 1)) || substr({col}, 2)"
