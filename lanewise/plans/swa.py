"""Sliding windows analysis: roads and crashes to scored windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..operators import counts as k
from ..operators.cells import within_distance
from ..operators.filters import drop_omitted, last_n_years
from ..operators.lrs import ROAD, short_windows, sliding_windows
from ..operators.network import dissolve_roads, dissolved_lines
from ..session import cut_lineage


@dataclass(frozen=True)
class SwaParams:
    """Window length in miles, windows per length, join distance in feet, severity weights."""

    window_mi: float = d.SLIDING_WINDOW_MI
    ratio: int = d.WINDOW_RATIO
    join_ft: float = d.JOIN_DISTANCE_FT
    weights: dict = field(default_factory=lambda: dict(d.CRASH_WEIGHTS))
    years: int = d.STUDY_YEARS

    @property
    def window_m(self) -> float:
        return self.window_mi * d.METERS_PER_MILE

    @property
    def step_m(self) -> float:
        return self.window_m / self.ratio

    @property
    def join_m(self) -> float:
        return self.join_ft * d.METERS_PER_FOOT


@dataclass(frozen=True)
class SwaResult:
    edges: DataFrame
    lines: DataFrame
    sliding: DataFrame
    short: DataFrame


def study_crashes(crashes: DataFrame, years: int | None = d.STUDY_YEARS) -> DataFrame:
    """Crashes that count: recent years, no omitted mode or severity."""
    recent = crashes if years is None else last_n_years(crashes, years)
    return drop_omitted(recent, k.MODE, k.SEVERITY)


def _study_columns(studies: DataFrame) -> DataFrame:
    """Parameters of :func:`~lanewise.sources.tables.study_params` in metres, one row per study."""
    window = F.col("sliding_window_length") * d.METERS_PER_MILE
    return studies.select(
        "study_id",
        window.alias("window_m"),
        F.try_divide(window, F.col("window_length_ratio")).alias("step_m"),
        (F.col("crash_join_distance") * d.METERS_PER_FOOT).alias("join_m"),
        "crash_weights",
    )


def with_params(edges: DataFrame, params: SwaParams | DataFrame) -> DataFrame:
    """Put window and step length next to each edge: constants, or the study's own values."""
    if isinstance(params, SwaParams):
        return edges.withColumn("window_m", F.lit(params.window_m)).withColumn("step_m", F.lit(params.step_m))
    return edges.join(_study_columns(params).select("study_id", "window_m", "step_m"), "study_id")


def scored_windows(edges: DataFrame, crashes: DataFrame, params: SwaParams | DataFrame) -> DataFrame:
    """Sliding windows reached by at least one crash, with counts, scores and measures.

    ``edges`` comes from :func:`with_params`.
    """
    fixed = isinstance(params, SwaParams)
    points = k.collapse_points(study_crashes(crashes, params.years if fixed else d.STUDY_YEARS))
    line = [*ROAD, "length_meters", "window_m", "step_m"]
    placed = edges.select(*line, "m0", "x0", "y0", "x1", "y1")
    if fixed:
        hits = within_distance(placed, points, params.join_m)
    else:
        own = _study_columns(params).select("study_id", "join_m")
        hits = within_distance(placed.join(own, "study_id"), points.join(own, "study_id"), "join_m")
    keys = [*line, "window_no"]
    once = (
        k.windows_reached(hits, "window_m", "step_m")
        .select(*keys, "x", "y", k.MODE, k.SEVERITY, "crashes")
        .distinct()
    )
    counts = k.window_counts(once, keys)
    if fixed:
        scored = k.window_scores(counts, params.weights)
    else:
        weights = _study_columns(params).select("study_id", "crash_weights")
        scored = k.window_scores(counts.join(weights, "study_id"), "crash_weights").drop("crash_weights")
    start = F.col("step_m") * F.col("window_no")
    return scored.withColumn("start_distance_m", start).withColumn(
        "end_distance_m", F.least(F.col("window_m") + start, F.col("length_meters"))
    )


def score_windows(
    edges: DataFrame, crashes: DataFrame, params: SwaParams | DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, all sliding windows with counts and scores, all short windows with scores.

    Short windows take their best score from the reached windows alone, so asking for them
    does not build the table of all sliding windows. The reached windows feed both and are written once: with
    them in the plan several times the driver's memory, which replans after each stage, grows with the copies.
    """
    edges = with_params(edges, params)
    lines = dissolved_lines(edges, ["window_m", "step_m"])
    reached = cut_lineage(scored_windows(edges, crashes, params))
    found = reached.select(*ROAD, "window_no", *d.COUNT_COLUMNS, *d.SCORE_COLUMNS)
    every = sliding_windows(lines, "window_m", "step_m")
    sliding = k.left_fill(every, found, [*ROAD, "window_no"], [*d.COUNT_COLUMNS, *d.SCORE_COLUMNS])
    best = k.max_overlapping_score(reached.filter(F.greatest(*d.SCORE_COLUMNS) > 0), "step_m")
    short = k.left_fill(short_windows(lines, "step_m"), best, [*ROAD, "segment_sequence"], d.SCORE_COLUMNS)
    return lines, sliding, short


def run_swa(
    roads: DataFrame, crashes: DataFrame, params: SwaParams | DataFrame = SwaParams()
) -> SwaResult:
    """Dissolve, count within distance, score, and carry the best score to short windows.

    ``params`` is one set for all studies or a table with each study's own
    (:func:`~lanewise.sources.tables.study_params`).

    The stitched edges and the reached windows feed several branches and are written once; the rest is lazy.
    """
    edges = cut_lineage(dissolve_roads(roads))
    lines, sliding, short = score_windows(edges, crashes, params)
    return SwaResult(edges, lines, sliding, short)
