"""Risk model: disaggregate predicted fatalities, expand severities, blend with crashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..operators import counts as k
from ..operators import estimates as e
from ..operators.cells import AREA_CELL_M, tile_polygons
from ..operators.filters import last_n_years
from ..operators.lrs import short_windows
from ..operators.network import dissolved_lines
from ..operators.skew import shuffled
from ..operators.summary import missing_non_fatal
from ..session import cut_lineage


@dataclass(frozen=True)
class ModelParams:
    window_mi: float = d.SLIDING_WINDOW_MI
    ratio: int = d.WINDOW_RATIO
    fine_mi: float = d.FINE_SEGMENT_MI
    join_ft: float = d.JOIN_DISTANCE_FT
    buffer_m: float = d.ROAD_BUFFER_M
    half_width: int = d.SMOOTH_HALF_WIDTH
    style: str = "linear"
    max_weight: float = d.MAX_PRIOR_WEIGHT
    decay: float = d.PRIOR_DECAY
    fatal_only: bool = False
    years: int | None = None
    state: str | None = None
    modes: dict = field(default_factory=lambda: {m: [m] for m in d.MODES})
    costs: dict = field(default_factory=lambda: dict(d.CRASH_COSTS))
    cell_m: float = AREA_CELL_M

    @property
    def step_m(self) -> float:
        return self.window_mi * d.METERS_PER_MILE / self.ratio

    @property
    def fine_m(self) -> float:
        return self.fine_mi * d.METERS_PER_MILE

    @property
    def join_m(self) -> float:
        return self.join_ft * d.METERS_PER_FOOT


@dataclass(frozen=True)
class ModelStore:
    """Inputs and results of the model; steps return a changed copy.

    ``block_groups`` holds predictions per geoid, ``tiles`` their (clipped) geometry cut by cell.
    ``states`` names the state of each study (``study_id, state``) unless the parameters name one.
    ``studies`` holds each study's own parameters (:func:`~lanewise.sources.tables.study_params`); they then take the place
    of window, ratio, join distance, weight, decay, costs and the fatal-only flag of the parameters. The flag is
    ``crash_missing_non_fatal`` of the table, or follows from the study's crashes where the table has no such column.
    A study without a row in ``studies`` gives no windows.
    """

    edges: DataFrame
    crashes: DataFrame
    block_groups: DataFrame
    rates: DataFrame
    ratios: DataFrame
    states: DataFrame | None = None
    studies: DataFrame | None = None
    tiles: DataFrame | None = None
    pieces: DataFrame | None = None
    windows: DataFrame | None = None
    fatal: DataFrame | None = None
    all_severity: DataFrame | None = None
    observed: DataFrame | None = None
    posterior: DataFrame | None = None


Step = Callable[[ModelStore, ModelParams], ModelStore]


def _with_state(df: DataFrame, s: ModelStore, p: ModelParams) -> DataFrame:
    return df if p.state is not None else df.join(s.states.select("study_id", "state"), "study_id")


def _step(s: ModelStore, p: ModelParams) -> float | str:
    return p.step_m if s.studies is None else "step_m"


def own_params(s: ModelStore, p: ModelParams) -> ModelStore:
    """Put each study's step and join distance next to its edges, if the studies have their own."""
    if s.studies is None:
        return s
    window = F.col("sliding_window_length") * d.METERS_PER_MILE
    own = s.studies.select(
        "study_id",
        F.try_divide(window, F.col("window_length_ratio")).alias("step_m"),
        (F.col("crash_join_distance") * d.METERS_PER_FOOT).alias("join_m"),
    )
    return replace(s, edges=s.edges.join(own, "study_id"))


def _blending(s: ModelStore) -> DataFrame:
    """Weight, decay, costs and fatal-only flag, one row per study."""
    studies, flag = s.studies, "crash_missing_non_fatal"
    if flag not in studies.columns:
        studies = studies.join(missing_non_fatal(s.crashes), "study_id", "left")
    return studies.select(
        "study_id",
        F.col("bayesian_max_prior_weight").cast("double").alias("_top"),
        F.col("bayesian_decay").cast("double").alias("_decay"),
        "crash_costs",
        F.coalesce(flag, F.lit(False)).alias("_fatal_only"),
    )


def build_windows(s: ModelStore, p: ModelParams) -> ModelStore:
    step = _step(s, p)
    lines = dissolved_lines(s.edges, [step] if isinstance(step, str) else [])
    windows = short_windows(lines, step).drop("start_x", "start_y")
    return replace(s, windows=_with_state(windows, s, p))


def assign_mileage(s: ModelStore, p: ModelParams) -> ModelStore:
    tiles = s.tiles
    if tiles is None:
        tiles = tile_polygons(s.block_groups.select("study_id", "geoid", "rings"), p.cell_m)
    pieces = e.effective_mileage(s.edges, tiles, _step(s, p), p.buffer_m, p.cell_m)
    return replace(s, pieces=cut_lineage(pieces))


def estimate_fatal(s: ModelStore, p: ModelParams) -> ModelStore:
    rated = e.initial_fatal(_with_state(s.pieces, s, p), s.rates, p.state)
    pieces = e.scaled_fatal(rated, s.block_groups)
    rolled = cut_lineage(e.segment_fatal(pieces))
    return replace(s, pieces=pieces, fatal=s.windows.join(shuffled(rolled), e.SEGMENT, "left"))


def estimate_severities(s: ModelStore, p: ModelParams) -> ModelStore:
    return replace(s, all_severity=e.expand_severity(s.fatal, s.ratios, p.state))


def count_observed(s: ModelStore, p: ModelParams) -> ModelStore:
    crashes = s.crashes if p.years is None else last_n_years(s.crashes, p.years)
    wanted = sorted({code for src in p.modes.values() for code in src})
    crashes = crashes.filter(F.col(k.MODE).isin(wanted) & F.col(k.SEVERITY).isin(d.SEVERITIES))
    reach = p.join_m if s.studies is None else "join_m"
    return replace(
        s,
        observed=cut_lineage(
            e.observed_counts(s.edges, crashes, _step(s, p), p.fine_m, reach, p.half_width, p.style, p.modes)
        ),
    )


def blend(s: ModelStore, p: ModelParams) -> ModelStore:
    cols = [c for c in s.observed.columns if c.endswith("_obs")]
    joined = k.left_fill(s.all_severity, s.observed, e.SEGMENT, cols, 0.0)
    if s.studies is not None:
        flag = F.col("_fatal_only")
        updated = e.eb_update(joined.join(_blending(s), "study_id"), F.col("_top"), F.col("_decay"), flag)
        priced = e.crash_costs(updated, "crash_costs", flag)
        return replace(s, posterior=priced.drop("_top", "_decay", "_fatal_only"))
    updated = e.eb_update(joined, p.max_weight, p.decay, p.fatal_only)
    return replace(s, posterior=e.crash_costs(updated, p.costs, p.fatal_only))


STEPS: list[Step] = [own_params, build_windows, assign_mileage, estimate_fatal, estimate_severities, count_observed, blend]


def run_model(
    inputs: ModelStore, params: ModelParams = ModelParams(), before: list[Step] = (), after: list[Step] = ()
) -> ModelStore:
    """Chain the steps over the store.

    The pieces of windows, their estimates by window and the observed counts are written when their step runs, so
    that no plan holds them several times or together; the other steps are lazy.
    """
    return reduce(lambda s, step: step(s, params), [*before, *STEPS, *after], inputs)


def model_output(s: ModelStore) -> DataFrame:
    """Result columns in order: window, variations, estimates, observations, weights, posteriors, costs.

    72 columns plus the road name and ``study_id``, by which the result is partitioned; with
    fatal crashes only, weights and posteriors exist for fatal crashes alone.
    """
    pairs = [(m, x) for m in d.MODES for x in e.KEYS]
    cols = (
        ["study_id", "dissolved_pkey", "road_name", "functional_class", "segment_sequence", "start_distance_m",
         "end_distance_m", "short_window_id"]
        + [f"{m}_cv" for m in d.MODES]
        + [f"est_{m}_{x}" for m, x in pairs]
        + [f"{m}_{x}_obs" for m, x in pairs]
        + [f"w_{m}_{x}" for m, x in pairs]
        + [f"adj_{m}_{x}" for m, x in pairs]
        + [f"total_{m}_cost" for m in d.MODES]
    )
    return s.posterior.select(*[c for c in cols if c in s.posterior.columns])
