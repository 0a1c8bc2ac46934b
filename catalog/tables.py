"""Queries over summaries, checks, recodes, rankings, sources and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise import domain as d
from lanewise.functions import geometry as g
from lanewise.functions.geometry import line_length
from lanewise.functions.text import pg_initcap
from lanewise.operators import classify, filters, quality, ranking, summary
from lanewise.session import cut_lineage
from lanewise.sinks import writers
from lanewise.sources import features, osm, tables

from . import fixtures as fx
from .registry import query, screening
from .sqltext import JOIN, SCREENING, SHORT, SHORT_SCORES, distance, near

OMIT = d.OMIT


def _r(col, digits=6):
    return F.round(F.col(col), digits).alias(col)


# ---------------------------------------------------------------- nearest road, cube

BASE = fx.cte("fx_roads", "fx_crashes")
NEAREST_ROAD = f"""{BASE},
recent AS (SELECT * FROM fx_crashes WHERE crash_severity <> '{OMIT}' AND crash_mode <> '{OMIT}'
             AND crash_year >= (SELECT max(crash_year) - 4 FROM fx_crashes)),
ranked AS (
  SELECT c.*, r.road_id, r.functional_class, {distance('c', 'r.x0', 'r.x1', 'r.y0')} AS dist,
         row_number() OVER (PARTITION BY c.crash_id ORDER BY {distance('c', 'r.x0', 'r.x1', 'r.y0')}, r.road_id) AS rn
  FROM recent c LEFT JOIN fx_roads r ON {near('r', 'r.x0', 'r.x1', 'r.y0')} AND r.functional_class <> '{OMIT}'),
nearest AS (SELECT * FROM ranked WHERE rn = 1)"""

CUBE = f"""{NEAREST_ROAD},
miles AS (SELECT functional_class, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) / 1609.34e0 AS mileage FROM fx_roads GROUP BY 1),
cube_rows AS (
  SELECT n.crash_year, n.crash_mode, n.crash_severity, n.functional_class, n.crash_count, coalesce(m.mileage, 0) AS mileage
  FROM (SELECT crash_year, crash_mode, crash_severity, functional_class, count(crash_id) AS crash_count FROM nearest GROUP BY ALL) n
  LEFT JOIN miles m ON m.functional_class = n.functional_class)"""


def _cube(spark, sf):
    return summary.crash_cube(fx.crashes(spark, sf), fx.roads(spark, sf), JOIN)


@query(
    "nearest_road",
    f"WITH {NEAREST_ROAD} SELECT crash_id, crash_year, road_id, functional_class, round(dist, 6) AS dist FROM nearest",
)
def nearest_road(spark, sf):
    kept = filters.drop_omitted(filters.last_n_years(fx.crashes(spark, sf)), "crash_severity", "crash_mode")
    out = summary.nearest_road(kept, fx.roads(spark, sf), JOIN)
    return out.select("crash_id", "crash_year", "road_id", "functional_class", _r("dist"))


@query("crash_cube", f"WITH {CUBE} SELECT * REPLACE (round(mileage, 6) AS mileage) FROM cube_rows")
def crash_cube(spark, sf):
    return _cube(spark, sf).select(*summary.CUBE, "crash_count", _r("mileage"))


@query(
    "mileage_by_class",
    f"""WITH {BASE} SELECT functional_class, round(sum(x1 - x0) / 1609.34e0, 6) AS mileage FROM fx_roads GROUP BY 1""",
)
def mileage_by_class(spark, sf):
    return summary.mileage_by_class(fx.roads(spark, sf)).select("functional_class", _r("mileage"))


def _summary_sql(col):
    return f"""WITH {CUBE}, s AS (SELECT {col}, sum(crash_count) AS n FROM cube_rows GROUP BY 1)
    SELECT {col}, cast(n AS bigint) AS total_crashes, round_even(n / (SELECT sum(n) FROM s) * 100.0, 1) AS percent_of_total FROM s"""


@query("summary_by_mode", _summary_sql("crash_mode"))
def summary_by_mode(spark, sf):
    return summary.category_summary(_cube(spark, sf), "crash_mode", d.MODES).drop("study_id")


@query("summary_by_severity", _summary_sql("crash_severity"))
def summary_by_severity(spark, sf):
    return summary.category_summary(_cube(spark, sf), "crash_severity", d.SEVERITIES).drop("study_id")


@query(
    "summary_sliced",
    f"""WITH {CUBE}, y AS (SELECT max(crash_year) AS last FROM cube_rows),
    s AS (SELECT crash_mode, sum(crash_count) AS n FROM cube_rows, y WHERE crash_year >= last - 2 AND crash_severity = 'K' GROUP BY 1)
    SELECT crash_mode, cast(n AS bigint) AS total_crashes, round_even(n / (SELECT sum(n) FROM s) * 100.0, 1) AS percent_of_total FROM s""",
)
def summary_sliced(spark, sf):
    cube = _cube(spark, sf)
    recent = cube.filter(F.col("crash_year") >= cube.agg(F.max("crash_year")).scalar() - 2)
    return summary.category_summary(filters.slice_cube(recent, severity="K"), "crash_mode", d.MODES).drop("study_id")


@query(
    "slice_cube",
    f"""WITH {CUBE} SELECT crash_year, crash_severity, functional_class, cast(sum(crash_count) AS bigint) AS crash_count
    FROM cube_rows WHERE crash_year BETWEEN 1996 AND 1997 AND crash_mode = 'bike' GROUP BY 1, 2, 3""",
)
def slice_cube(spark, sf):
    s = filters.slice_cube(_cube(spark, sf), 1996, 1997, mode="bike")
    return s.groupBy("crash_year", "crash_severity", "functional_class").agg(F.sum("crash_count").alias("crash_count"))


def _cross_sql(row, col, names, where="TRUE"):
    cells = ", ".join(f"coalesce(sum(CASE WHEN {col} = '{v}' THEN crash_count END), 0) AS \"{n}\"" for v, n in names.items())
    total = " + ".join(f'"{n}"' for n in names.values())
    pct = ", ".join(f'coalesce(round_even("{n}" / nullif(total, 0) * 100.0, 1), 0) AS "{n}_pct"' for n in names.values())
    return f"""WITH {CUBE}, t AS (
      SELECT {row}, {cells} FROM cube_rows WHERE {col} IS NOT NULL AND {where} GROUP BY {row}
      UNION ALL SELECT 'All' AS {row}, {cells} FROM cube_rows WHERE {col} IS NOT NULL AND {where}),
    u AS (SELECT *, {total} AS total FROM t)
    SELECT {row}, {", ".join(f'cast("{n}" AS bigint) AS "{n}"' for n in names.values())}, cast(total AS bigint) AS total, {pct} FROM u"""


_MODE_NAMES = {m: m for m in d.MODES}
_CLASS_NAMES = {c: c.lower().replace(" ", "_") for c in d.FUNCTIONAL_CLASSES}


@query("mode_by_severity", _cross_sql("crash_severity", "crash_mode", _MODE_NAMES))
def mode_by_severity(spark, sf):
    return summary.cross_tab(_cube(spark, sf), "crash_severity", "crash_mode", d.MODES, d.SEVERITIES, totals=True).drop("study_id")


@query("class_by_severity", _cross_sql("crash_severity", "functional_class", _CLASS_NAMES, "crash_mode = 'ped'"))
def class_by_severity(spark, sf):
    cube = filters.slice_cube(_cube(spark, sf), mode="ped")
    return summary.cross_tab(
        cube, "crash_severity", "functional_class", d.FUNCTIONAL_CLASSES, d.SEVERITIES, totals=True, names=_CLASS_NAMES
    ).drop("study_id")


_YEARS_BACK = list(range(d.STUDY_YEARS))


@query(
    "severity_by_year",
    f"""WITH {CUBE}, latest AS (SELECT max(crash_year) AS y FROM cube_rows) SELECT crash_severity,
    {", ".join(f"cast(coalesce(sum(CASE WHEN crash_year = y - {b} THEN crash_count END), 0) AS bigint) AS back_{b}" for b in _YEARS_BACK)}
    FROM cube_rows, latest GROUP BY 1""",
)
def severity_by_year(spark, sf):
    """Years counted back from the latest one, so the columns hold whatever years the table has."""
    cube = _cube(spark, sf)
    back = cube.agg(F.max("crash_year")).scalar() - F.col("crash_year")
    names = {b: f"back_{b}" for b in _YEARS_BACK}
    return summary.cross_tab(
        cube.withColumn("years_back", back), "crash_severity", "years_back", _YEARS_BACK, d.SEVERITIES, names=names
    ).drop("study_id")


@query(
    "severity_by_class_complete",
    f"""WITH {CUBE}, s AS (SELECT unnest(['K', 'A', 'B', 'C', 'O']) AS crash_severity)
    SELECT s.crash_severity,
    {", ".join(f"cast(coalesce(sum(CASE WHEN c.functional_class = '{v}' THEN crash_count END), 0) AS bigint) AS {n}" for v, n in _CLASS_NAMES.items())}
    FROM s LEFT JOIN cube_rows c ON c.crash_severity = s.crash_severity AND c.crash_mode = 'bike' AND c.crash_severity IN ('K', 'A') GROUP BY 1""",
)
def severity_by_class_complete(spark, sf):
    """All severities appear even where the selection holds only two of them."""
    cube = filters.keep_domain(filters.slice_cube(_cube(spark, sf), mode="bike"), {"crash_severity": ["K", "A"]})
    return summary.cross_tab(
        cube, "crash_severity", "functional_class", d.FUNCTIONAL_CLASSES, d.SEVERITIES, complete_rows=True, names=_CLASS_NAMES
    ).drop("study_id")


@query(
    "filter_options",
    f"""WITH {CUBE} SELECT value, label, cast(position AS int) AS position FROM (VALUES
    {", ".join(f"('{s}', '{d.SEVERITY_LABELS[s]}', {i})" for i, s in enumerate(d.SEVERITIES))}) v(value, label, position)
    WHERE value IN (SELECT crash_severity FROM cube_rows)""",
)
def filter_options(spark, sf):
    return summary.filter_options(_cube(spark, sf), "crash_severity", d.SEVERITY_LABELS).drop("study_id")


@query("year_range", f"WITH {CUBE} SELECT min(crash_year) AS min_year, max(crash_year) AS max_year FROM cube_rows")
def year_range(spark, sf):
    return summary.year_range(_cube(spark, sf)).drop("study_id")


_TWO = "cast(CASE WHEN functional_class IN ('Local Road', 'Expressway') THEN 2 ELSE 1 END AS int)"


def _two_studies(cube):
    """The cube as that of two studies, told apart by class; the second one lacks its latest year."""
    two = cube.withColumn("study_id", F.expr(_TWO))
    return two.filter((F.col("study_id") == 1) | (F.col("crash_year") < cube.agg(F.max("crash_year")).scalar()))


TWO_STUDIES = f"""{CUBE}, two AS (SELECT {_TWO} AS study_id, c.* FROM cube_rows c
    WHERE {_TWO} = 1 OR crash_year < (SELECT max(crash_year) FROM cube_rows))"""


@query(
    "multi_study_summary",
    f"""WITH {TWO_STUDIES}, s AS (SELECT study_id, crash_mode, sum(crash_count) AS n FROM two GROUP BY 1, 2)
    SELECT study_id, crash_mode, cast(n AS bigint) AS total_crashes,
      round_even(n / (SELECT sum(n) FROM s t WHERE t.study_id = s.study_id) * 100.0, 1) AS percent_of_total FROM s""",
)
def multi_study_summary(spark, sf):
    return summary.category_summary(_two_studies(_cube(spark, sf)), "crash_mode", d.MODES)


@query("multi_study_years", f"WITH {TWO_STUDIES} SELECT study_id, min(crash_year) AS min_year, max(crash_year) AS max_year FROM two GROUP BY 1")
def multi_study_years(spark, sf):
    return summary.year_range(_two_studies(_cube(spark, sf)))


@query(
    "multi_study_cross_tab",
    f"""WITH {TWO_STUDIES}, r AS (
      SELECT study_id, crash_severity, {", ".join(f"sum(CASE WHEN crash_mode = '{m}' THEN crash_count ELSE 0 END) AS {m}" for m in d.MODES)} FROM two GROUP BY 1, 2
      UNION ALL SELECT study_id, 'All', {", ".join(f"sum(CASE WHEN crash_mode = '{m}' THEN crash_count ELSE 0 END) AS {m}" for m in d.MODES)} FROM two GROUP BY 1)
    SELECT study_id, crash_severity, {", ".join(f"cast({m} AS bigint) AS {m}" for m in d.MODES)}, cast({" + ".join(d.MODES)} AS bigint) AS total,
      {", ".join(f"coalesce(round_even({m} / nullif({' + '.join(d.MODES)}, 0) * 100.0, 1), 0) AS {m}_pct" for m in d.MODES)} FROM r""",
)
def multi_study_cross_tab(spark, sf):
    return summary.cross_tab(_two_studies(_cube(spark, sf)), "crash_severity", "crash_mode", d.MODES, d.SEVERITIES, totals=True)


# ---------------------------------------------------------------- report tables


@query(
    "multi_study_proportions",
    f"""WITH {BASE}, two AS (SELECT cast(1 + crash_id % 2 AS int) AS study_id, crash_severity FROM fx_crashes),
    n AS (SELECT study_id, crash_severity, count(*) AS n FROM two GROUP BY 1, 2)
    SELECT study_id, crash_severity, cast(n AS double) AS total_count,
      round(n / (SELECT sum(n) FROM n t WHERE t.study_id = n.study_id), 8) AS proportion FROM n""",
)
def multi_study_proportions(spark, sf):
    two = fx.crashes(spark, sf).withColumn("study_id", (1 + F.col("crash_id") % 2).cast("int"))
    return summary.proportions(two, "crash_severity").select("study_id", "crash_severity", "total_count", _r("proportion", 8))


@query(
    "multi_study_latest",
    f"""WITH {BASE}, two AS (SELECT cast(1 + crash_id % 2 AS int) AS study_id, crash_id, crash_year FROM fx_crashes)
    SELECT study_id, crash_id, crash_year FROM (SELECT *, row_number() OVER (PARTITION BY study_id
      ORDER BY crash_year DESC NULLS LAST, crash_id DESC) AS r FROM two) t WHERE r <= 50""",
)
def multi_study_latest(spark, sf):
    two = fx.crashes(spark, sf).withColumn("study_id", (1 + F.col("crash_id") % 2).cast("int"))
    return ranking.latest(two, 50).select("study_id", "crash_id", "crash_year")


@query(
    "severity_proportions",
    f"""WITH {BASE} SELECT crash_severity, cast(count(*) AS double) AS total_count,
    round(count(*) / (SELECT count(*) FROM fx_crashes), 8) AS proportion FROM fx_crashes GROUP BY 1""",
)
def severity_proportions(spark, sf):
    p = summary.proportions(fx.crashes(spark, sf), "crash_severity")
    return p.select("crash_severity", "total_count", _r("proportion", 8))


@query(
    "cost_summary",
    f"""WITH {BASE}, n AS (SELECT crash_severity, count(*) AS n FROM fx_crashes GROUP BY 1)
    SELECT v.s AS crash_severity, cast(v.c AS double) AS crash_cost, cast(coalesce(n, 0) AS double) AS total_count,
      round(coalesce(n, 0) / (SELECT sum(n) FROM n), 8) AS proportion
    FROM (VALUES {", ".join(f"('{s}', {c})" for s, c in d.CRASH_COSTS.items())}) v(s, c) LEFT JOIN n ON n.crash_severity = v.s""",
)
def cost_summary(spark, sf):
    p = summary.cost_summary(fx.crashes(spark, sf), d.CRASH_COSTS)
    return p.select("crash_severity", "crash_cost", "total_count", _r("proportion", 8))


_MODE_CODES = {"Pedestrian": "ped", "Person on foot": "ped", "Cyclist": "bike", "Scooter": "micro"}


@query(
    "mapping_report_mode",
    f"""WITH {BASE}, n AS (SELECT crash_mode, count(*) AS n FROM fx_crashes GROUP BY 1),
    g AS (SELECT m, string_agg(raw, chr(10) ORDER BY pos) AS codes FROM (VALUES
      {", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_MODE_CODES.items()))}) v(raw, m, pos) GROUP BY m)
    SELECT coalesce(g.codes, n.crash_mode) AS dataset_values, coalesce(n.crash_mode, g.m) AS crash_mode,
      cast(coalesce(n.n, 0) AS double) AS total_count, round(coalesce(n.n, 0) / (SELECT sum(n) FROM n), 8) AS proportion
    FROM n FULL OUTER JOIN g ON g.m = n.crash_mode""",
)
def mapping_report_mode(spark, sf):
    metric = summary.proportions(fx.crashes(spark, sf), "crash_mode")
    out = summary.mapping_report(filters.mapping_table(spark, _MODE_CODES), metric, "crash_mode", d.MODES)
    return out.select("dataset_values", "crash_mode", "total_count", _r("proportion", 8))


@query(
    "mapping_report_class",
    f"""WITH {BASE}, n AS (SELECT functional_class, sum(x1 - x0) / 1609.34e0 AS n FROM fx_roads GROUP BY 1),
    g AS (SELECT m, string_agg(raw, chr(10) ORDER BY pos) AS codes FROM (VALUES
      {", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(d.OSM_CLASS_MAP.items()))}) v(raw, m, pos) GROUP BY m)
    SELECT coalesce(g.codes, n.functional_class) AS dataset_values, coalesce(n.functional_class, g.m) AS functional_class,
      round(coalesce(n.n, 0), 6) AS total_miles, round(coalesce(n.n, 0) / (SELECT sum(n) FROM n), 8) AS proportion
    FROM n FULL OUTER JOIN g ON g.m = n.functional_class""",
)
def mapping_report_class(spark, sf):
    metric = summary.proportions(
        fx.roads(spark, sf), "functional_class", line_length(F.col("geom")) / d.METERS_PER_MILE, "total_miles"
    )
    out = summary.mapping_report(
        filters.mapping_table(spark, d.OSM_CLASS_MAP), metric, "functional_class", value="total_miles"
    )
    return out.select("dataset_values", "functional_class", _r("total_miles"), _r("proportion", 8))


# ---------------------------------------------------------------- profiles and checks


def _key_sql(cte, table, col):
    return f"""WITH {cte} SELECT count(*) AS total_count, count(DISTINCT {col}) AS unique_count,
    count(*) FILTER ({col} IS NULL) AS null_count, count(*) = count(DISTINCT {col}) AS is_unique,
    count(*) FILTER ({col} IS NULL) = 0 AS no_nulls FROM {table}"""


@query("key_profile", _key_sql(BASE, "fx_crashes", "crash_id"))
def key_profile(spark, sf):
    return summary.key_profile(fx.crashes(spark, sf), "crash_id")


@query("key_profile_with_nulls", _key_sql(BASE, "fx_roads", "road_name"))
def key_profile_with_nulls(spark, sf):
    return summary.key_profile(fx.roads(spark, sf), "road_name")


@query(
    "check_key",
    f"""WITH {BASE} SELECT 'road_name_unique' AS check_name,
    CASE WHEN count(*) = count(DISTINCT road_name) THEN 'ok' ELSE 'critical' END AS level,
    count(*) - count(DISTINCT road_name) AS violations FROM fx_roads""",
)
def check_key(spark, sf):
    return quality.check_key(fx.roads(spark, sf), "road_name")


RAW_CODES = """raw_codes AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN concat(' ', o_orderpriority)
       ELSE o_orderpriority END AS code FROM orders)"""


def _raw_codes(spark, sf):
    o = fx.read(spark, sf, "orders")
    k = F.col("o_orderkey") % 7
    code = (
        F.when(k == 0, F.lit(None)).when(k == 1, F.lit("   "))
        .when(k == 2, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    )
    return o.select(F.col("o_orderkey").alias("id"), code.alias("code"))


@query(
    "code_profile",
    f"""WITH {RAW_CODES} SELECT CASE WHEN code IS NULL THEN '{d.NULL_KEY}' WHEN trim(code) = '' THEN '{d.EMPTY_KEY}' ELSE trim(code) END AS code,
    count(*) AS row_count FROM raw_codes GROUP BY 1""",
)
def code_profile(spark, sf):
    return summary.code_profile(_raw_codes(spark, sf), "code")


_SEVERITY_CODES = {
    "1-URGENT": "K", "2-HIGH": "A", "3-MEDIUM": "B", d.NULL_KEY: OMIT, d.EMPTY_KEY: "O",
}
_RECODE = f"""CASE WHEN code = '1-URGENT' THEN 'K' WHEN code = '2-HIGH' THEN 'A' WHEN code = '3-MEDIUM' THEN 'B'
  WHEN code IS NULL THEN '{OMIT}' WHEN trim(code) = '' THEN 'O' ELSE 'unknown severity' END"""


@query("recode_severities", f"WITH {RAW_CODES} SELECT id, {_RECODE} AS severity FROM raw_codes")
def recode_severities(spark, sf):
    r = filters.recode(_raw_codes(spark, sf), "code", _SEVERITY_CODES, "unknown severity", into="severity")
    return r.select("id", "severity")


@query("recode_by_join", f"WITH {RAW_CODES} SELECT id, {_RECODE.replace('WHEN code =', 'WHEN trim(code) =')} AS severity FROM raw_codes")
def recode_by_join(spark, sf):
    """The same recode with the map as a table and trimmed comparison."""
    codes = filters.mapping_table(spark, _SEVERITY_CODES)
    return filters.recode(_raw_codes(spark, sf), "code", codes, "unknown severity", trim=True, into="severity").select("id", "severity")


@query(
    "labelled_modes",
    f"""WITH {BASE} SELECT CASE crash_mode WHEN 'ped' THEN 'Pedestrian' WHEN 'bike' THEN 'Bicycle' WHEN 'mv' THEN 'Motor Vehicle'
    ELSE crash_mode END AS mode_label, 'K' AS crash_severity, count(*) AS crashes FROM fx_crashes GROUP BY 1""",
)
def labelled_modes(spark, sf):
    c = filters.with_constant(fx.crashes(spark, sf), "crash_severity", "K")
    return filters.label(c, "crash_mode", d.MODE_LABELS, "mode_label").groupBy("mode_label", "crash_severity").agg(
        F.count(F.lit(1)).alias("crashes")
    )


@query(
    "missing_non_fatal",
    f"""WITH {BASE} SELECT study_id, NOT bool_or(crash_severity IN ('A', 'B', 'C', 'O')) AS crash_missing_non_fatal
    FROM (SELECT CASE WHEN crash_mode = 'ped' THEN 1 ELSE 2 END AS study_id,
                 CASE WHEN crash_mode = 'ped' THEN 'K' ELSE crash_severity END AS crash_severity FROM fx_crashes) t GROUP BY 1""",
)
def missing_non_fatal(spark, sf):
    ped = F.col("crash_mode") == "ped"
    c = fx.crashes(spark, sf).select(
        F.when(ped, 1).otherwise(2).alias("study_id"),
        F.when(ped, "K").otherwise(F.col("crash_severity")).alias("crash_severity"),
    )
    return summary.missing_non_fatal(c)


_CHECK = "SELECT '{}' AS check_name, CASE WHEN {} THEN '{}' ELSE 'ok' END AS level, cast(coalesce({}, 0) AS bigint) AS violations FROM {}"


@query(
    "check_inputs",
    f"""WITH {BASE}, {fx.cte('fx_area')},
    r AS (SELECT count(*) AS n, sum(x1 - x0) / 1609.34e0 AS miles, count(*) FILTER (functional_class NOT IN ({", ".join(f"'{c}'" for c in [*d.FUNCTIONAL_CLASSES, OMIT])})) AS bad FROM fx_roads),
    a AS (SELECT count(*) AS n FROM fx_area),
    c AS (SELECT count(*) AS n, min(crash_year) AS y0, max(crash_year) AS y1, count(*) FILTER (crash_year IS NULL) AS no_year,
       count(*) FILTER (crash_year < (SELECT max(crash_year) - 4 FROM fx_crashes)) AS old,
       count(*) FILTER (crash_mode NOT IN ('ped', 'bike', 'mv', '{OMIT}')) AS bad_mode,
       count(*) FILTER (crash_severity NOT IN ('K', 'A', 'B', 'C', 'O', '{OMIT}')) AS bad_severity,
       count(*) FILTER (crash_severity IN ('A', 'B', 'C', 'O')) AS non_fatal FROM fx_crashes)
    {_CHECK.format('area_present', 'n = 0', 'critical', 'n', 'a')}
    UNION ALL {_CHECK.format('roads_present', 'n = 0', 'critical', 'n', 'r')}
    UNION ALL {_CHECK.format('road_miles_limit', 'miles > 100', 'info', 'floor(miles)', 'r')}
    UNION ALL {_CHECK.format('road_class_domain', 'bad > 0', 'critical', 'bad', 'r')}
    UNION ALL {_CHECK.format('crashes_present', 'n = 0', 'critical', 'n', 'c')}
    UNION ALL {_CHECK.format('crash_count_limit', 'n > 250000', 'info', 'n', 'c')}
    UNION ALL {_CHECK.format('crash_map_warning', 'n > 1000', 'info', 'n', 'c')}
    UNION ALL {_CHECK.format('crash_year_known', 'y1 IS NULL', 'critical', 'no_year', 'c')}
    UNION ALL {_CHECK.format('crash_year_missing', 'no_year > 0', 'info', 'no_year', 'c')}
    UNION ALL {_CHECK.format('crash_year_span', 'y0 > y1 - 4', 'info', 'y1 - y0 + 1', 'c')}
    UNION ALL {_CHECK.format('crash_year_old', 'old > 0', 'info', 'old', 'c')}
    UNION ALL {_CHECK.format('crash_mode_domain', 'bad_mode > 0', 'critical', 'bad_mode', 'c')}
    UNION ALL {_CHECK.format('crash_severity_domain', 'bad_severity > 0', 'critical', 'bad_severity', 'c')}
    UNION ALL {_CHECK.format('crash_non_fatal_missing', 'non_fatal = 0', 'info', 'non_fatal', 'c')}""",
)
def check_inputs(spark, sf):
    return quality.check_inputs(
        fx.roads(spark, sf), fx.crashes(spark, sf), fx.area(spark, sf), max_miles=100, large_crashes=1000
    )


_STUDY_OF = "(1 + cast(floor({} / 200) AS int) % 2)"
_STUDY_CHECK = _CHECK.replace("SELECT", "SELECT study_id,", 1)


@query(
    "multi_study_checks",
    f"""WITH {BASE}, {fx.cte('fx_area')}, all_studies AS (SELECT cast(unnest(range(1, 4)) AS int) AS study_id),
    r0 AS (SELECT *, {_STUDY_OF.format('y0')} AS study_id FROM (SELECT x0, x1, y0, functional_class FROM fx_roads) t),
    c0 AS (SELECT {_STUDY_OF.format('y')} AS study_id, crash_year - CASE WHEN {_STUDY_OF.format('y')} = 2 THEN 3 ELSE 0 END AS crash_year,
      CASE WHEN {_STUDY_OF.format('y')} = 2 THEN 'K' ELSE crash_severity END AS crash_severity, crash_mode FROM fx_crashes),
    r1 AS (SELECT study_id, count(*) AS n, sum(x1 - x0) / 1609.34e0 AS miles,
      count(*) FILTER (functional_class NOT IN ({", ".join(f"'{c}'" for c in [*d.FUNCTIONAL_CLASSES, OMIT])})) AS bad FROM r0 GROUP BY 1),
    r AS (SELECT study_id, coalesce(n, 0) AS n, miles, bad FROM all_studies LEFT JOIN r1 USING (study_id)),
    a AS (SELECT study_id, CASE WHEN study_id <> 2 THEN (SELECT count(*) FROM fx_area) ELSE 0 END AS n FROM all_studies),
    newest AS (SELECT study_id, max(crash_year) AS y FROM c0 GROUP BY 1),
    c1 AS (SELECT study_id, count(*) AS n, min(crash_year) AS y0, max(crash_year) AS y1, count(*) FILTER (crash_year IS NULL) AS no_year,
       count(*) FILTER (crash_year < y - 4) AS old, count(*) FILTER (crash_mode NOT IN ('ped', 'bike', 'mv', '{OMIT}')) AS bad_mode,
       count(*) FILTER (crash_severity NOT IN ('K', 'A', 'B', 'C', 'O', '{OMIT}')) AS bad_severity,
       count(*) FILTER (crash_severity IN ('A', 'B', 'C', 'O')) AS non_fatal FROM c0 JOIN newest USING (study_id) GROUP BY 1),
    c AS (SELECT study_id, coalesce(n, 0) AS n, c1.y0, y1, no_year, old, bad_mode, bad_severity, non_fatal FROM all_studies LEFT JOIN c1 USING (study_id))
    {_STUDY_CHECK.format('area_present', 'n = 0', 'critical', 'n', 'a')}
    UNION ALL {_STUDY_CHECK.format('roads_present', 'n = 0', 'critical', 'n', 'r')}
    UNION ALL {_STUDY_CHECK.format('road_miles_limit', 'miles > 100', 'info', 'floor(miles)', 'r')}
    UNION ALL {_STUDY_CHECK.format('road_class_domain', 'bad > 0', 'critical', 'bad', 'r')}
    UNION ALL {_STUDY_CHECK.format('crashes_present', 'n = 0', 'critical', 'n', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_count_limit', 'n > 250000', 'info', 'n', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_map_warning', 'n > 1000', 'info', 'n', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_year_known', 'y1 IS NULL', 'critical', 'no_year', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_year_missing', 'no_year > 0', 'info', 'no_year', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_year_span', 'y0 > y1 - 4', 'info', 'y1 - y0 + 1', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_year_old', 'old > 0', 'info', 'old', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_mode_domain', 'bad_mode > 0', 'critical', 'bad_mode', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_severity_domain', 'bad_severity > 0', 'critical', 'bad_severity', 'c')}
    UNION ALL {_STUDY_CHECK.format('crash_non_fatal_missing', 'coalesce(non_fatal, 0) = 0', 'info', 'non_fatal', 'c')}""",
)
def multi_study_checks(spark, sf):
    """Lines per study: the second has no area, fatal crashes only and another latest year, the third nothing but an area."""
    study = lambda y: (1 + F.floor(y / 200) % 2).cast("int")
    second = F.col("study_id") == 2
    crashes = fx.crashes(spark, sf).withColumn("study_id", study(F.col("y")))
    crashes = crashes.withColumn("crash_year", F.col("crash_year") - F.when(second, 3).otherwise(0))
    crashes = crashes.withColumn("crash_severity", F.when(second, "K").otherwise(F.col("crash_severity")))
    roads = fx.roads(spark, sf).withColumn("study_id", study(F.element_at("geom", 1)["y"]))
    area = fx.area(spark, sf).withColumn("study_id", F.explode(F.array(F.lit(1), F.lit(3))))
    studies = spark.range(1, 4).select(F.col("id").cast("int").alias("study_id"))
    return quality.check_inputs(roads, crashes, area, max_miles=100, large_crashes=1000, studies=studies)


STUDIES = """studies AS (
  SELECT s_suppkey AS study_id,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE cast(25 + 5 * (s_suppkey % 40) AS double) / 100 END AS sliding_window_length,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE cast(s_suppkey % 12 AS int) END AS window_length_ratio,
    CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE cast(10 + s_suppkey % 260 AS int) END AS crash_join_distance,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast(s_suppkey % 24 AS int) END AS top_streets_threshold,
    cast(s_suppkey % 5 AS int) AS wk, cast(s_suppkey % 3 AS int) AS wa, cast(s_suppkey % 2 AS int) AS wb, 0 AS wc, 0 AS wo,
    cast(1000 * (s_suppkey % 7) AS int) AS ck, 3000 AS ca FROM supplier)"""


def _studies(spark, sf):
    text = STUDIES[STUDIES.index("(") + 1 : STUDIES.rindex(")")].replace("FROM supplier", "FROM {supplier}")
    s = spark.sql(text, supplier=fx.read(spark, sf, "supplier"))
    w = F.create_map(*[x for k, c in zip(d.SEVERITIES, ["wk", "wa", "wb", "wc", "wo"]) for x in (F.lit(k), F.col(c))])
    c = F.create_map(F.lit("K"), F.col("ck"), F.lit("A"), F.col("ca"))
    return s.withColumn("crash_weights", w).withColumn("crash_costs", c).drop("wk", "wa", "wb", "wc", "wo", "ck", "ca")


@query(
    "study_params",
    f"""WITH {STUDIES} SELECT study_id, coalesce(sliding_window_length, 0.5e0) AS sliding_window_length,
    coalesce(window_length_ratio, 5) AS window_length_ratio, coalesce(crash_join_distance, 50) AS crash_join_distance,
    coalesce(top_streets_threshold, 10) AS top_streets_threshold, wk AS weight_k, ck AS cost_k, 384000 AS cost_b,
    round(CASE WHEN coalesce(window_length_ratio, 5) <> 0 THEN coalesce(sliding_window_length, 0.5e0) / coalesce(window_length_ratio, 5) END, 6) AS short_window_length
    FROM studies""",
)
def study_params(spark, sf):
    p = tables.study_params(_studies(spark, sf))
    return p.select(
        "study_id", "sliding_window_length", "window_length_ratio", "crash_join_distance", "top_streets_threshold",
        F.col("crash_weights")["K"].alias("weight_k"), F.col("crash_costs")["K"].alias("cost_k"),
        F.col("crash_costs")["B"].alias("cost_b"), _r("short_window_length"),
    )


@query(
    "check_params",
    f"""WITH {STUDIES}
    SELECT study_id, 'weights_all_zero' AS rule FROM studies WHERE wk + wa + wb + wc + wo = 0
    UNION ALL SELECT study_id, 'weights_order' FROM studies WHERE wk < wa OR wa < wb
    UNION ALL SELECT study_id, 'window_length' FROM studies WHERE sliding_window_length IS NULL OR sliding_window_length NOT BETWEEN 0.25 AND 2
    UNION ALL SELECT study_id, 'window_ratio' FROM studies WHERE window_length_ratio IS NULL OR window_length_ratio NOT BETWEEN 1 AND 10
    UNION ALL SELECT study_id, 'join_distance' FROM studies WHERE crash_join_distance IS NULL OR crash_join_distance NOT BETWEEN 25 AND 250
    UNION ALL SELECT study_id, 'top_streets' FROM studies WHERE top_streets_threshold IS NULL OR top_streets_threshold NOT BETWEEN 5 AND 20
    UNION ALL SELECT study_id, 'costs_order' FROM studies""",
)
def check_params(spark, sf):
    """Stored parameters as they are; every study lacks some costs, so their order cannot hold."""
    return quality.check_params(_studies(spark, sf))


# ---------------------------------------------------------------- ranking, classes, exports


@query(
    "priority_flag",
    f"""WITH {BASE}, k AS (SELECT * FROM fx_crashes WHERE crash_mode <> '{OMIT}' AND crash_severity <> '{OMIT}')
    SELECT crash_id, crash_mode, count(*) OVER (PARTITION BY crash_mode) AS mode_total,
      row_number() OVER (PARTITION BY crash_mode ORDER BY crash_year DESC NULLS LAST, crash_id DESC) <= 500 AS priority FROM k""",
)
def priority_flag(spark, sf):
    c = filters.keep_domain(fx.crashes(spark, sf), {"crash_mode": d.MODES, "crash_severity": d.SEVERITIES})
    return ranking.priority_flag(c, 500).select("crash_id", "crash_mode", "mode_total", "priority")


@query(
    "latest_crashes",
    f"""WITH {BASE} SELECT crash_id, crash_year FROM fx_crashes ORDER BY crash_year DESC NULLS LAST, crash_id DESC LIMIT 200""",
)
def latest_crashes(spark, sf):
    return ranking.latest(fx.crashes(spark, sf), 200).select("crash_id", "crash_year")


def _long_scores(spark, sf):
    _, _, short = screening(spark, sf)
    return short.filter(F.greatest(*d.SCORE_COLUMNS) > 0).select(
        "start_x", "start_y", "segment_sequence",
        F.explode(F.array(*[F.struct(F.lit(m).alias("crash_mode"), F.col(d.score_column(m)).alias("score")) for m in d.MODES])).alias("s"),
    ).select("start_x", "start_y", "segment_sequence", "s.*").filter(F.col("score") > 0)


@query("natural_breaks")
def natural_breaks(spark, sf):
    """Optimal class limits; no SQL form, the tests compare with an exhaustive search."""
    return classify.natural_breaks(_long_scores(spark, sf), "score", ["crash_mode"], 5)


@query(
    "assign_class",
    f"""WITH {SCREENING}, {SHORT}, {SHORT_SCORES},
    l AS ({" UNION ALL ".join(f"SELECT start_x, start_y, segment_sequence, '{m}' AS crash_mode, {d.score_column(m)} AS score FROM short_scores" for m in d.MODES)}),
    b AS (SELECT crash_mode, cast(sum(score) AS double) / count(*) AS mean, cast(max(score) AS double) AS top FROM l WHERE score > 0 GROUP BY crash_mode)
    SELECT start_x, start_y, cast(segment_sequence AS int) AS segment_sequence, l.crash_mode, score,
      CASE WHEN score <= mean THEN 0 WHEN score <= (mean + top) / 2 THEN 1 ELSE 2 END AS class_no
    FROM l JOIN b ON l.crash_mode = b.crash_mode WHERE score > 0""",
)
def assign_class(spark, sf):
    """Classes between the least, the mean and the largest score of each mode, so every score has one."""
    scores = cut_lineage(_long_scores(spark, sf))  # read three times
    low, mean, top = F.min("score").cast("double"), F.sum("score").cast("double") / F.count("score"), F.max("score").cast("double")
    limits = scores.groupBy("crash_mode").agg(F.array(low, mean, (mean + top) / 2, top).alias("breaks"))
    return classify.assign_class(scores, limits, "score", ["crash_mode"], ["start_x", "start_y", "segment_sequence"])


@query(
    "export_view",
    f"""WITH {BASE} SELECT crash_id, CASE WHEN crash_mode = 'ped' THEN 1 WHEN crash_mode = '{OMIT}' THEN NULL ELSE 0 END AS is_ped,
      CASE WHEN crash_year IS NULL THEN '' ELSE concat(crash_mode, ',', crash_severity) END AS codes,
      cast(round(cast(x / 7 AS decimal(28,10)), 2) AS decimal(28,2)) AS x FROM fx_crashes WHERE crash_severity = 'K'""",
)
def export_view(spark, sf):
    c = fx.crashes(spark, sf)
    wide = c.select(
        "crash_id", "crash_severity",
        F.when(F.col("crash_mode") != OMIT, F.col("crash_mode") == "ped").alias("is_ped"),
        F.when(F.col("crash_year").isNotNull(), F.array("crash_mode", "crash_severity")).alias("codes"),
        (F.col("x") / 7).alias("x"),
    )
    out = writers.export_view(
        wide, ["crash_id", "is_ped", "codes", "x", "crash_id"], F.col("crash_severity") == "K", digits={"x": 2}
    )
    return out.withColumn("x", F.col("x").cast("decimal(28,2)"))


@query(
    "geojson_crashes",
    f"""WITH {BASE} SELECT concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', cast(x AS bigint), '.0,', cast(y AS bigint), '.0]}},"properties":{{"crash_id":', crash_id,
     ',"severity":"', crash_severity, '"}}}}') AS feature FROM fx_crashes WHERE crash_mode IN ('ped', 'bike', 'mv') AND crash_severity IN ('K', 'A', 'B', 'C', 'O')""",
)
def geojson_crashes(spark, sf):
    c = filters.keep_domain(fx.crashes(spark, sf), {"crash_mode": d.MODES, "crash_severity": d.SEVERITIES})
    return writers.to_geojson(
        c, writers.point_geometry("x", "y"), {"crash_id": "crash_id", "severity": "crash_severity"},
        [writers.severity_draw_order(), F.col("crash_id")],
    )


@query(
    "geojson_roads",
    f"""WITH {BASE} SELECT concat('{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[', cast(x0 AS bigint), '.0,', cast(y0 AS bigint), '.0],[', cast(x1 AS bigint), '.0,', cast(y1 AS bigint),
     '.0]]}},"properties":{{"road_id":', road_id, ',"Road Name":', coalesce('"' || road_name || '"', 'null'), '}}}}') AS feature FROM fx_roads WHERE functional_class <> '{OMIT}'""",
)
def geojson_roads(spark, sf):
    r = filters.drop_omitted(fx.roads(spark, sf), "functional_class")
    return writers.to_geojson(r, writers.line_geometry("geom"), {"road_id": "road_id", "Road Name": "road_name"})


# ---------------------------------------------------------------- sources

_TAGS = ["residential", "primary", "service", "footway", "motorway_link", "unclassified", "track"]
WAYS = f"""ways AS (
  SELECT p_partkey AS osm_id, p_name AS name,
    CASE p_size % 8 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAGS))} END AS highway,
    CASE WHEN p_partkey % 11 = 0 THEN 'private' WHEN p_partkey % 13 = 0 THEN 'no' WHEN p_partkey % 3 = 0 THEN 'yes' END AS access,
    CASE WHEN p_partkey % 17 = 0 THEN 'yes' END AS area FROM part)"""
_OPEN = f"""SELECT * FROM ways WHERE highway IN ({", ".join(f"'{h}'" for h in osm.HIGHWAYS)})
   AND coalesce(area, '') <> 'yes' AND coalesce(access, '') NOT IN ('private', 'no')"""


def _ways(spark, sf):
    p = fx.read(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size") % 8
    highway = F.lit(None).cast("string")
    for i, t in enumerate(_TAGS):
        highway = F.when(size == i, F.lit(t)).otherwise(highway)
    access = F.when(key % 11 == 0, "private").when(key % 13 == 0, "no").when(key % 3 == 0, "yes")
    area = F.when(key % 17 == 0, "yes")
    tags = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("k"), c.alias("v")) for n, c in
                      (("highway", highway), ("name", F.col("p_name")), ("access", access), ("area", area))]),
            lambda e: e["v"].isNotNull(),
        )
    )
    nodes = F.transform(F.sequence(F.lit(0), (key % 4).cast("int") + 1), lambda i: key + i * 3)
    return p.select(key.alias("osm_id"), tags.alias("tags"), nodes.alias("node_ids"))


@query("osm_roads", f"WITH {WAYS} SELECT osm_id, highway, name, access FROM ({_OPEN}) t")
def osm_roads(spark, sf):
    return osm.osm_roads(_ways(spark, sf)).select("osm_id", "highway", "name", "access")


@query(
    "osm_way_lines",
    f"""WITH {WAYS}, refs AS (SELECT osm_id, i, osm_id + i * 3 AS node_id FROM (SELECT *, unnest(generate_series(0, osm_id % 4 + 1)) AS i FROM ({_OPEN}) t) u),
    placed AS (SELECT r.*, cast(p_partkey % 360 - 180 AS double) AS lon, cast(p_size AS double) AS lat FROM refs r JOIN part ON p_partkey = r.node_id)
    SELECT osm_id, cast(count(*) AS int) AS vertices, arg_min(lon, i) AS first_lon, arg_max(lat, i) AS last_lat FROM placed GROUP BY osm_id HAVING count(*) >= 2""",
)
def osm_way_lines(spark, sf):
    p = fx.read(spark, sf, "part")
    nodes = p.select(
        F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 360 - 180).cast("double").alias("lon"),
        F.col("p_size").cast("double").alias("lat"),
    )
    w = osm.assemble_ways(osm.osm_roads(_ways(spark, sf)), nodes)
    return w.select(
        "osm_id", F.size("geom").alias("vertices"), F.element_at("geom", 1)["x"].alias("first_lon"),
        F.element_at("geom", -1)["y"].alias("last_lat"),
    )


@query("highway_values", f"WITH {WAYS} SELECT DISTINCT highway FROM ({_OPEN}) t")
def highway_values(spark, sf):
    return osm.distinct_values(osm.osm_roads(_ways(spark, sf)), "highway")


@query(
    "retain_recent",
    """SELECT year(o_orderdate) AS year, count(*) AS crashes FROM orders
    WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 4 FROM orders) GROUP BY 1""",
)
def retain_recent(spark, sf):
    o = fx.read(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"))
    return tables.retain_recent(o).groupBy("year").agg(F.count(F.lit(1)).alias("crashes"))


@query(
    "numeric_lookup",
    """SELECT p_brand AS code, count(*) AS n, count(try_cast(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE cast(p_size AS varchar) END AS double)) AS parsed,
    sum(try_cast(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE cast(p_size AS varchar) END AS double)) AS total FROM part GROUP BY 1""",
)
def numeric_lookup(spark, sf):
    p = fx.read(spark, sf, "part").select(
        F.col("p_brand").alias("code"),
        F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("rate"),
    )
    return tables.to_numeric(p, ["rate"]).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.count("rate").alias("parsed"), F.sum("rate").alias("total")
    )


@query("state_names", "SELECT DISTINCT r_name AS state_name FROM region")
def state_names(spark, sf):
    r = fx.read(spark, sf, "region").withColumnRenamed("r_name", "state_name")
    return tables.area_names(r, "state_name")


@query(
    "county_names",
    "SELECT DISTINCT n_name AS namelsad FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def county_names(spark, sf):
    n = fx.read(spark, sf, "nation").join(fx.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = n.select(F.col("n_name").alias("namelsad"), F.col("r_name").alias("state_name"))
    return tables.area_names(named, "namelsad", "ASIA")


@query(
    "area_boundary",
    f"""WITH {fx.cte('fx_block_groups')} SELECT cast(7 AS int) AS study_id, bx0, by0 FROM fx_block_groups WHERE final_pred_ped > 1""",
)
def area_boundary(spark, sf):
    b = tables.area_boundary(fx.block_groups(spark, sf), F.col("final_pred_ped") > 1, 7)
    first = F.element_at(F.element_at("rings", 1), 1)
    return b.select("study_id", first["x"].alias("bx0"), first["y"].alias("by0"))


@query(
    "builtin_roads",
    f"""WITH {WAYS} SELECT CASE {" ".join(f"WHEN highway = '{h}' THEN '{c}'" for h, c in d.OSM_CLASS_MAP.items())} ELSE 'unknown fclass value' END AS functional_class,
    count(*) AS roads FROM ways GROUP BY 1""",
)
def builtin_roads(spark, sf):
    w = _ways(spark, sf).select(
        F.lit(1).alias("study_id"), "osm_id", F.element_at("tags", F.lit("name")).alias("name"),
        F.element_at("tags", F.lit("highway")).alias("highway"), F.lit(None).alias("geom"),
    )
    return tables.resolve_roads("builtin", national=w).groupBy("functional_class").agg(F.count(F.lit(1)).alias("roads"))


@query(
    "builtin_crashes",
    """SELECT crash_mode, crash_severity, crash_year, count(*) AS crashes FROM (
      SELECT CASE o_orderkey % 7 WHEN 0 THEN 'bike' WHEN 1 THEN 'mv' WHEN 2 THEN 'mv' WHEN 3 THEN 'ped'
          WHEN 4 THEN 'Omit From Analysis' WHEN 5 THEN 'Omit From Analysis' ELSE 'unknown mode' END AS crash_mode,
        'K' AS crash_severity, cast(year(o_orderdate) AS int) AS crash_year FROM orders) t GROUP BY ALL""",
)
def builtin_crashes(spark, sf):
    kinds = [*d.NATIONAL_MODE_MAP, "Unlisted"]
    o = fx.read(spark, sf, "orders")
    national = o.select(
        F.lit(1).alias("study_id"), F.col("o_orderkey").alias("year_st_case"), F.year("o_orderdate").alias("year"),
        F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 7).cast("int")).alias("crash_mode"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
    )
    return tables.resolve_crashes("builtin", national=national).groupBy("crash_mode", "crash_severity", "crash_year").agg(
        F.count(F.lit(1)).alias("crashes")
    )


@query(
    "upload_crashes",
    f"""WITH {RAW_CODES} SELECT severity AS crash_severity, crash_mode, count(*) AS crashes FROM (
      SELECT {_RECODE} AS severity, CASE WHEN id % 2 = 0 THEN 'ped' ELSE 'unknown mode' END AS crash_mode FROM raw_codes) t GROUP BY ALL""",
)
def upload_crashes(spark, sf):
    raw = _raw_codes(spark, sf).select(
        F.lit(1).alias("study_id"), "id", F.lit("2020").alias("yr"),
        F.when(F.col("id") % 2 == 0, "P").otherwise("Q").alias("kind"), "code", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
    )
    c = tables.resolve_crashes(
        "upload", upload=raw,
        columns={"crash_id": "id", "crash_year": "yr", "crash_mode": "kind", "crash_severity": "code"},
        modes={"P": "ped"}, severities=_SEVERITY_CODES,
    )
    return c.groupBy("crash_severity", "crash_mode").agg(F.count(F.lit(1)).alias("crashes"))


@query(
    "parse_line_features",
    f"""WITH {BASE} SELECT outcome, count(*) AS features, cast(sum(n) AS bigint) AS vertices, round(sum(x), 4) AS x_sum, count(road_name) AS named FROM (
      SELECT CASE WHEN road_id % 7 IN (0, 1) THEN 'no geometry' WHEN road_id % 7 = 2 THEN 'geometry type not allowed' ELSE 'kept' END AS outcome,
        CASE WHEN road_id % 7 = 6 THEN 4 WHEN road_id % 7 > 2 THEN 2 END AS n,
        CASE WHEN road_id % 7 > 2 THEN x0 END * CASE WHEN road_id % 7 = 6 THEN 2 ELSE 1 END AS x,
        CASE WHEN road_id % 7 > 0 THEN road_name END AS road_name FROM fx_roads) t GROUP BY 1""",
)
def parse_line_features(spark, sf):
    """One GeoJSON feature per row: broken text, no geometry, points, lines and lines of two parts."""
    r, kind = fx.derived(spark, sf, "fx_roads"), F.col("road_id") % 7
    pair = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), pair("x0", "y0"), F.lit(","), pair("x1", "y1"), F.lit("]"))
    geometry = (
        F.when(kind == 1, F.lit("null"))
        .when(kind == 2, F.concat(F.lit('{"type":"Point","coordinates":'), pair("x0", "y0"), F.lit("}")))
        .when(kind == 6, F.concat(F.lit('{"type":"MultiLineString","coordinates":['), line, F.lit(","), line, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), line, F.lit("}")))
    )
    named = F.to_json(F.struct("road_name"))
    text = F.concat(F.lit('{"type":"Feature","properties":'), named, F.lit(',"geometry":'), geometry, F.lit("}"))
    parsed = features.parse_features(
        r.select(F.when(kind == 0, F.lit("{broken")).otherwise(text).alias("value")), geom_types=["LineString", "MultiLineString"], properties=["road_name"]
    )
    kept = features.lines(parsed.rows.withColumn("_id", F.monotonically_increasing_id())).groupBy("_id").agg(
        F.sum(F.size("geom")).alias("n"), F.sum(F.element_at("geom", 1)["x"]).alias("x"), F.first("road_name").alias("road_name")
    )
    good = kept.select(F.lit("kept").alias("outcome"), F.col("n").cast("bigint").alias("n"), "x", "road_name")
    bad = parsed.rejects.select(
        F.col("reason").alias("outcome"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("x"), "road_name"
    )
    return good.unionByName(bad).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("features"), F.sum("n").alias("vertices"), F.round(F.sum("x"), 4).alias("x_sum"), F.count("road_name").alias("named")
    )


@query(
    "parse_polygon_features",
    f"""WITH fx_block_groups AS ({fx.BLOCK_GROUPS}) SELECT geoid, cast(CASE WHEN cast(geoid AS int) % 2 = 0 THEN 2 ELSE 1 END AS int) AS parts, round(bx0, 4) AS x_min,
      round((bx1 - bx0) * (by1 - by0) * CASE WHEN cast(geoid AS int) % 2 = 0 THEN 2 ELSE 1 END, 4) AS area FROM fx_block_groups""",
)
def parse_polygon_features(spark, sf):
    """Polygons and polygons of two parts read from GeoJSON text."""
    b = fx.block_groups(spark, sf)
    rings = F.to_json(F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    even = F.col("geoid").cast("int") % 2 == 0
    geometry = F.when(
        even, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), rings, F.lit(","), rings, F.lit("]}"))
    ).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), rings, F.lit("}")))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("geoid")), F.lit(',"geometry":'), geometry, F.lit("}"))
    parsed = features.parse_features(b.select(text.alias("value")), geom_types=["Polygon", "MultiPolygon"], properties=["geoid"])
    box = g.bbox(F.element_at("rings", 1))
    parts = features.polygons(parsed.rows).select("geoid", box.alias("b"))
    area = (F.col("b.xmax") - F.col("b.xmin")) * (F.col("b.ymax") - F.col("b.ymin"))
    return parts.groupBy("geoid").agg(
        F.count(F.lit(1)).cast("int").alias("parts"), F.round(F.min("b.xmin"), 4).alias("x_min"), F.round(F.sum(area), 4).alias("area")
    )


@query(
    "parse_lookup",
    """SELECT p_brand AS code, count(*) AS n, count(CASE WHEN p_size % 5 > 0 THEN 1 END) AS parsed,
      cast(sum(CASE WHEN p_size % 5 > 0 THEN p_size END) AS double) AS total FROM part GROUP BY 1""",
)
def parse_lookup(spark, sf):
    """Lookup rows from CSV text; some numbers are missing, some are words."""
    size = F.col("p_size").cast("string")
    rate = F.when(F.col("p_size") % 10 == 0, F.lit("n/a")).when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(size)
    text = F.concat(F.lit('"'), F.col("p_brand"), F.lit('",'), rate)
    parsed = tables.parse_lookup(fx.read(spark, sf, "part").select(text.alias("value")), ["code", "rate"], ["rate"])
    return parsed.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("rate").alias("parsed"), F.sum("rate").alias("total"))


@query(
    "repeated_crash_ids",
    f"""WITH {BASE} SELECT crash_mode, count(DISTINCT crash_id) AS crashes FROM fx_crashes GROUP BY 1""",
)
def repeated_crash_ids(spark, sf):
    """Every crash twice, once moved far away: one row per id stays, the one near a road."""
    c = fx.crashes(spark, sf)
    moved = c.withColumn("x", F.col("x") + 1e7)
    found = summary.nearest_road(c.unionByName(moved), fx.roads(spark, sf), JOIN)
    return found.groupBy("crash_mode").agg(F.count(F.lit(1)).alias("crashes"))


@query(
    "feature_checks",
    """SELECT coalesce(reason, 'kept') AS outcome, count(*) AS features, round(sum(lon), 4) AS lon_sum FROM (
      SELECT CASE WHEN c_custkey % 10 = 0 THEN 'no geometry' WHEN c_custkey % 10 = 1 THEN 'geometry type not allowed' END AS reason,
             CASE WHEN c_custkey % 10 > 1 THEN cast(c_custkey % 360 - 180 AS double) END AS lon FROM customer) t GROUP BY 1""",
)
def feature_checks(spark, sf):
    """GeoJSON text to points; rows without a usable geometry are set aside with a reason."""
    c, key = fx.read(spark, sf, "customer"), F.col("c_custkey")
    coords = F.concat(F.lit("["), (key % 360 - 180).cast("string"), F.lit(","), (key % 80).cast("string"), F.lit("]"))
    text = F.when(key % 10 == 0, F.lit(None)).when(
        key % 10 == 1, F.concat(F.lit('{"type":"LineString","coordinates":['), coords, F.lit("]}"))
    ).otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), coords, F.lit("}")))
    checked = features.check_features(features._with_geometry(c.select("c_custkey", text.alias("geometry"))), ["Point"])
    kept = features.points(checked.rows).select(F.lit("kept").alias("outcome"), "lon")
    bad = checked.rejects.select(F.col("reason").alias("outcome"), F.lit(None).cast("double").alias("lon"))
    return kept.unionByName(bad).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("lon"), 4).alias("lon_sum")
    )


@query(
    "initcap_names",
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(title), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)', 1),
        lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title
      FROM (SELECT doc_id, concat(source, '-', lang, ' o''', source, '/', lang) AS title FROM documents) t""",
)
def initcap_names(spark, sf):
    title = F.concat("source", F.lit("-"), "lang", F.lit(" o'"), "source", F.lit("/"), "lang")
    return fx.read(spark, sf, "documents").select("doc_id", pg_initcap(title).alias("title"))
