"""Lookups, named areas, source selection, retention and study parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain as d
from ..operators.filters import recode, with_constant
from ..operators.outlines import dissolve_polygons

# --- fixed values: columns of the national sources ---------------------------------
ROAD_COLUMNS = {"road_id": "osm_id", "road_name": "name", "functional_class": "highway"}
CRASH_COLUMNS = {"crash_id": "year_st_case", "crash_year": "year", "crash_mode": "crash_mode"}
UNKNOWN = {
    "functional_class": "unknown fclass value",
    "crash_mode": "unknown mode",
    "crash_severity": "unknown severity",
}
# ----------------------------------------------------------------------------------


def load_lookup(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """CSV lookup with a header; numbers that do not parse become null."""
    return to_numeric(spark.read.csv(path, header=True), numeric)


def parse_lookup(lines: DataFrame, columns: list[str], numeric: list[str], text_col: str = "value") -> DataFrame:
    """Lookup from rows of CSV text without a header; short rows have nulls, numbers that do not parse become null."""
    row = F.from_csv(text_col, ", ".join(f"`{c}` string" for c in columns))
    return to_numeric(lines.select(row.alias("r")).select("r.*"), numeric)


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def retain_recent(df: DataFrame, year: str = "year", n: int = d.STUDY_YEARS) -> DataFrame:
    """Drop rows older than the last ``n`` years of the table; rows without a year stay."""
    latest = df.agg(F.max(year)).scalar()
    return df.filter(F.col(year).isNull() | (F.col(year) > latest - n))


def resolve_roads(
    kind: str, national: DataFrame | None = None, upload: DataFrame | None = None,
    columns: dict[str, str] | None = None, classes: dict[str, str] | None = None,
) -> DataFrame:
    """Study roads from the national extract or an upload, columns and classes standardised."""
    source = national if kind == "builtin" else upload
    names = ROAD_COLUMNS if kind == "builtin" else columns
    mapping = classes if classes is not None else d.OSM_CLASS_MAP
    picked = source.select("study_id", *[F.col(c).alias(n) for n, c in names.items()], "geom")
    return recode(picked, "functional_class", mapping, UNKNOWN["functional_class"])


def resolve_crashes(
    kind: str, national: DataFrame | None = None, upload: DataFrame | None = None,
    columns: dict[str, str] | None = None, modes: dict[str, str] | None = None, severities: dict[str, str] | None = None,
) -> DataFrame:
    """Study crashes; the national source is fatal-only, so its severity is constant."""
    if kind == "builtin":
        picked = national.select("study_id", *[F.col(c).alias(n) for n, c in CRASH_COLUMNS.items()], "x", "y")
        out = with_constant(recode(picked, "crash_mode", d.NATIONAL_MODE_MAP, UNKNOWN["crash_mode"]), "crash_severity", "K")
    else:
        picked = upload.select("study_id", *[F.col(c).alias(n) for n, c in columns.items()], "x", "y")
        out = recode(picked, "crash_mode", modes, UNKNOWN["crash_mode"])
        out = recode(out, "crash_severity", severities, UNKNOWN["crash_severity"])
    return out.withColumn("crash_year", F.col("crash_year").cast("int"))


def area_names(df: DataFrame, name: str, state: str | None = None, state_col: str = "state_name") -> DataFrame:
    """Sorted names of the areas, all or those of one state."""
    rows = df if state is None else df.filter(F.col(state_col) == state)
    return rows.select(F.col(name).cast("string").alias(name)).distinct().orderBy(name)


def area_boundary(df: DataFrame, where: Column, study_id) -> DataFrame:
    """Boundary of the selected areas: all their polygons under one study key."""
    return df.filter(where).select(F.lit(study_id).alias("study_id"), "rings")


def dissolved_boundary(df: DataFrame, where: Column, study_id) -> DataFrame:
    """Boundary of the selected areas without the borders between them: one row per separate part."""
    return dissolve_polygons(area_boundary(df, where, study_id), ["study_id"])


def default_params() -> dict:
    return {
        "sliding_window_length": d.SLIDING_WINDOW_MI,
        "window_length_ratio": d.WINDOW_RATIO,
        "crash_join_distance": d.JOIN_DISTANCE_FT,
        "top_streets_threshold": d.TOP_STREETS,
        "bayesian_decay": d.PRIOR_DECAY,
        "bayesian_max_prior_weight": d.MAX_PRIOR_WEIGHT,
    }


def study_params(studies: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Parameters per study, defaults filling each missing field and map entry.

    The short window length, where not stored, follows from length and ratio; it is null for a ratio of 0,
    which :func:`~lanewise.operators.quality.check_params` reports.
    """
    out = studies
    for name, value in (defaults or default_params()).items():
        have = F.col(name) if name in studies.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(have, F.lit(value)))
    for name, fixed in (("crash_weights", d.CRASH_WEIGHTS), ("crash_costs", d.CRASH_COSTS)):
        if name in studies.columns:
            entry = {s: F.coalesce(F.element_at(F.col(name), F.lit(s)), F.lit(v)) for s, v in fixed.items()}
        else:
            entry = {s: F.lit(v) for s, v in fixed.items()}
        out = out.withColumn(name, F.create_map(*[x for s, v in entry.items() for x in (F.lit(s), v)]))
    derived = F.try_divide(F.col("sliding_window_length"), F.col("window_length_ratio"))
    stored = F.col("short_window_length") if "short_window_length" in studies.columns else F.lit(None)
    return out.withColumn("short_window_length", F.coalesce(stored, derived))
