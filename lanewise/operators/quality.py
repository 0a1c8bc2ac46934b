"""Input and parameter checks as rows ``(check_name, level, violations)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..functions.geometry import line_length
from .summary import key_profile

CRITICAL, INFO, OK = "critical", "info", "ok"


def _line(name: str, bad: Column, level: str, count: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(bad, F.lit(level)).otherwise(F.lit(OK)).alias("level"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("violations"),
    )


def check_inputs(
    roads: DataFrame,
    crashes: DataFrame,
    area: DataFrame,
    max_miles: float = d.MAX_ROAD_MILES,
    max_crashes: int = d.MAX_CRASHES,
    large_crashes: int = d.LARGE_CRASH_COUNT,
    studies: DataFrame | None = None,
) -> DataFrame:
    """Presence, year coverage, code domains and volumes, in one pass per input.

    With ``studies`` (distinct ``study_id``) every study gets its own lines, under its id and against its own latest year, those without
    rows in an input included; without it all rows are checked as one study.

    The volume limits only inform: they guard a single machine's memory elsewhere, not a
    cluster's, and callers may set their own.
    """
    classes = [*d.FUNCTIONAL_CLASSES, d.OMIT]
    keys = [] if studies is None else ["study_id"]

    def summed(df, *sums):
        if not keys:
            return df.agg(*sums)
        return studies.select(*keys).join(df.groupBy(*keys).agg(*sums), keys, "left").fillna(0, "n")

    r = summed(
        roads,
        F.count(F.lit(1)).alias("n"),
        (F.sum(line_length(F.col("geom"))) / d.METERS_PER_MILE).alias("miles"),
        F.count_if(~F.col("functional_class").isin(classes)).alias("bad"),
    )
    years = crashes.groupBy(*keys, "crash_year").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("crash_mode").isin([*d.MODES, d.OMIT])).alias("bad_mode"),
        F.count_if(~F.col("crash_severity").isin([*d.SEVERITIES, d.OMIT])).alias("bad_severity"),
        F.count_if(F.col("crash_severity").isin(d.SEVERITIES[1:])).alias("non_fatal"),
    )
    y = F.col("crash_year")
    # a row per year and study
    last_year = F.max("crash_year").alias("_last")
    dated = years.join(years.groupBy(*keys).agg(last_year), keys) if keys else years.withColumn("_last", years.agg(last_year).scalar())
    c = summed(
        dated,
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min(y).alias("first_year"),
        F.max(y).alias("last_year"),
        F.sum(F.when(y.isNull(), F.col("n"))).alias("no_year"),
        F.sum(F.when(y < F.col("_last") - (d.STUDY_YEARS - 1), F.col("n"))).alias("old"),
        *[F.sum(x).alias(x) for x in ("bad_mode", "bad_severity", "non_fatal")],
    )
    first, last = F.col("first_year"), F.col("last_year")
    span = d.STUDY_YEARS - 1

    def nz(name):
        return F.coalesce(F.col(name), F.lit(0))

    area_lines = summed(area, F.count(F.lit(1)).alias("n")).select(
        *keys, F.array(_line("area_present", F.col("n") == 0, CRITICAL, F.col("n"))).alias("l")
    )
    road_lines = r.select(
        *keys,
        F.array(
            _line("roads_present", F.col("n") == 0, CRITICAL, F.col("n")),
            _line("road_miles_limit", F.coalesce(F.col("miles") > max_miles, F.lit(False)), INFO, F.floor("miles")),
            _line("road_class_domain", F.col("bad") > 0, CRITICAL, F.col("bad")),
        ).alias("l")
    )
    crash_lines = c.select(
        *keys,
        F.array(
            _line("crashes_present", F.col("n") == 0, CRITICAL, F.col("n")),
            _line("crash_count_limit", F.col("n") > max_crashes, INFO, F.col("n")),
            _line("crash_map_warning", F.col("n") > large_crashes, INFO, F.col("n")),
            _line("crash_year_known", last.isNull(), CRITICAL, nz("no_year")),
            _line("crash_year_missing", nz("no_year") > 0, INFO, nz("no_year")),
            _line("crash_year_span", first > last - span, INFO, last - first + 1),
            _line("crash_year_old", nz("old") > 0, INFO, nz("old")),
            _line("crash_mode_domain", nz("bad_mode") > 0, CRITICAL, nz("bad_mode")),
            _line("crash_severity_domain", nz("bad_severity") > 0, CRITICAL, nz("bad_severity")),
            _line("crash_non_fatal_missing", nz("non_fatal") == 0, INFO, nz("non_fatal")),
        ).alias("l")
    )
    return area_lines.unionByName(road_lines).unionByName(crash_lines).select(*keys, F.explode("l").alias("_l")).select(*keys, "_l.*")


def check_params(studies: DataFrame) -> DataFrame:
    """Rule violations of study parameters: rows ``(study_id, rule)``.

    ``crash_weights`` and ``crash_costs`` are maps by severity.
    """
    w = [F.element_at("crash_weights", F.lit(s)) for s in d.SEVERITIES]
    c = [F.element_at("crash_costs", F.lit(s)) for s in d.SEVERITIES]

    def either(tests):
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.coalesce(out, F.lit(True))

    mile, ratio = F.col("sliding_window_length"), F.col("window_length_ratio")
    dist, top = F.col("crash_join_distance"), F.col("top_streets_threshold")
    hundredths = F.round(mile * 100, 6)
    rules = {
        "weights_range": either([x.isNull() | (x < 0) | (x > 100) | (x != F.floor(x)) for x in w]),
        "weights_all_zero": F.coalesce(sum(w[1:], w[0]) == 0, F.lit(True)),
        "weights_order": either([a < b for a, b in zip(w, w[1:])]),
        "window_length": either([mile.isNull(), ~mile.between(0.25, 2), hundredths % 5 != 0]),
        "window_ratio": either([ratio.isNull(), ~ratio.between(1, 10), ratio != F.floor(ratio)]),
        "join_distance": either([dist.isNull(), ~dist.between(25, 250), dist != F.floor(dist)]),
        "top_streets": either([top.isNull(), ~top.between(5, 20), top != F.floor(top)]),
        "costs_order": either([a < b for a, b in zip(c, c[1:])]),
    }
    broken = F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])
    return studies.select("study_id", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def check_key(df: DataFrame, col: str) -> DataFrame:
    """One line: critical when the key has duplicates or nulls."""
    p = key_profile(df, col)
    line = _line(f"{col}_unique", ~F.col("is_unique"), CRITICAL, F.col("total_count") - F.col("unique_count"))
    return p.select(line.alias("_l")).select("_l.*")
