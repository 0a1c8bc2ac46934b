"""Crash estimates: area shares, fatality disaggregation, severities, Bayes update, costs.

Estimates stay wide (one column per mode and severity): every step but the roll-ups is a
projection, so nothing is shuffled fifteen times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domain as d
from ..functions.text import to_int_rounded
from . import counts as k
from .cells import AREA_CELL_M, buffer_overlap, within_distance
from .lrs import ROAD, _num, cut_at_steps, step_bounds, step_count
from .skew import salted_join

SEGMENT = [*ROAD, "segment_sequence"]
KEYS = [s.lower() for s in d.SEVERITIES]
INFINITY = float("inf")


def scale_by_area(block_groups: DataFrame, pieces: DataFrame, full_area: str = "area_sq_m") -> DataFrame:
    """Scale predictions and errors by the share of each block group left after clipping.

    Block groups without a piece are dropped; a full area of zero leaves values unscaled.
    """
    left = pieces.groupBy("study_id", "geoid").agg(F.sum("area").alias("clipped_area"))
    share = F.when(F.col(full_area) > 0, F.col("clipped_area") / F.col(full_area)).otherwise(F.lit(1.0))
    cols = [f"final_{p}_{m}" for p in ("pred", "se") for m in d.MODES]
    return block_groups.join(left, ["study_id", "geoid"]).withColumns({c: F.col(c) * share for c in cols})


def _own(value) -> list[str]:
    """The column that holds a parameter, where each study has its own value."""
    return [value] if isinstance(value, str) else []


def share_of_total(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Share of a value in its group's total; groups here are small (pieces of one segment)."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(into, F.col(value) / F.when(total != 0, total))


def segment_length(step) -> Column:
    """Unrounded length in metres of short window ``segment_sequence``."""
    step = _num(step)
    start = step * F.col("segment_sequence")
    return F.least(step * (F.col("segment_sequence") + 1), F.col("length_meters")) - start


def effective_mileage(
    edges: DataFrame, tiles: DataFrame, step, width: float = d.ROAD_BUFFER_M, cell: float = AREA_CELL_M
) -> DataFrame:
    """Miles of each short window that count towards each block group.

    The window's length is split in proportion to the area its buffer shares with each.
    ``step`` is a number or a column of ``edges``.
    """
    carried = [*SEGMENT, "functional_class", "length_meters", *_own(step)]
    pieces = cut_at_steps(edges, step).select(*carried, "x0", "y0", "x1", "y1")
    found = buffer_overlap(pieces, tiles, carried, "geoid", width, cell, place_by=SEGMENT)
    shared = share_of_total(found, SEGMENT, "piece_area", "_share")
    return shared.withColumn("roadway_length_mi", segment_length(step) / d.METERS_PER_MILE).select(
        *SEGMENT,
        "functional_class",
        "geoid",
        "piece_area",
        "roadway_length_mi",
        (F.col("roadway_length_mi") * F.col("_share")).alias("effective_mileage"),
    )


def with_rates(pieces: DataFrame, rates: DataFrame, state: str | None) -> DataFrame:
    """Attach fatality rates by class; ``state`` names one, else both sides carry ``state``.

    Classes without a rate keep nulls. The table has one row per state and class.
    """
    if state is not None:
        return pieces.join(rates.filter(F.col("state") == state).drop("state"), "functional_class", "left")
    return pieces.join(rates, ["state", "functional_class"], "left")


def initial_fatal(pieces: DataFrame, rates: DataFrame, state: str | None, years: int = d.RATE_YEARS) -> DataFrame:
    """First estimate per piece and mode: miles times yearly rate times years."""
    rated = with_rates(pieces, rates, state)
    return rated.withColumns(
        {f"init_{m}_k": F.col("effective_mileage") * F.col(f"{m}_fatal_rate") * years for m in d.MODES}
    ).drop(*[f"{m}_fatal_rate" for m in d.MODES])


def scale_to_control(
    df: DataFrame, group: list[str], controls: DataFrame, pairs: dict[str, str], salt_on: list[str], prefix="est_"
) -> DataFrame:
    """Scale columns so that each group adds up to its control total.

    ``pairs`` maps a value column to the control column. A group whose values add up to zero gets
    factor 0. Totals are combined map-side; attaching them back splits hot groups.
    """
    totals = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(v).alias(f"_sum_{v}") for v in pairs]
    )
    factors = totals.drop("_rows").join(controls, group).withColumns(
        {
            f"_f_{v}": F.when(F.coalesce(F.col(f"_sum_{v}"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
                F.col(c) / F.col(f"_sum_{v}")
            )
            for v, c in pairs.items()
        }
    ).drop(*[f"_sum_{v}" for v in pairs])
    scaled = salted_join(df, factors, group, salt_on, sizes=totals.select(*group, "_rows"))
    return scaled.withColumns(
        {f"{prefix}{v.removeprefix('init_')}": F.col(v) * F.col(f"_f_{v}") for v in pairs}
    ).drop(*[f"_f_{v}" for v in pairs])


def scaled_fatal(pieces: DataFrame, block_groups: DataFrame) -> DataFrame:
    """Estimates per piece that add up to each block group's prediction."""
    cols = [f"final_{p}_{m}" for p in ("pred", "se") for m in d.MODES]
    controls = block_groups.groupBy("study_id", "geoid").agg(*[F.max(c).alias(c) for c in cols])
    pairs = {f"init_{m}_k": f"final_pred_{m}" for m in d.MODES}
    return scale_to_control(pieces, ["study_id", "geoid"], controls, pairs, SEGMENT)


def variation(se: Column, pred: Column) -> Column:
    """Coefficient of variation: infinite for an error without a prediction, null for 0/0."""
    return F.when(pred != 0, se / F.when(pred != 0, pred)).when(
        (pred == 0) & (se != 0), F.lit(INFINITY) * F.signum(se)
    )


def segment_fatal(pieces: DataFrame) -> DataFrame:
    """Roll pieces up to short windows: estimates added, variations weighted by miles.

    A sum without values is 0; a piece without a variation still weighs in the mileage.
    """
    miles = F.sum("effective_mileage")
    aggs = []
    for m in d.MODES:
        cv = variation(F.col(f"final_se_{m}"), F.col(f"final_pred_{m}"))
        weighted = F.coalesce(F.sum(cv * F.col("effective_mileage")), F.lit(0.0))
        aggs.append(F.coalesce(F.sum(f"est_{m}_k"), F.lit(0.0)).alias(f"est_{m}_k"))
        aggs.append((weighted / F.when(miles != 0, miles)).alias(f"{m}_cv"))
    return pieces.groupBy(*SEGMENT).agg(*aggs)


def with_ratios(df: DataFrame, ratios: DataFrame, state: str | None) -> DataFrame:
    """Attach a state's severity ratios (columns ``{mode}_{severity}``); an unknown state fails the job."""
    cols = [f"{m}_{s}" for m in d.MODES for s in KEYS]
    table = ratios.select("state", *[F.col(c).cast("double").alias(f"_r_{c}") for c in cols], F.lit(1).alias("_known"))
    keyed = df if state is None else df.withColumn("state", F.lit(state))
    joined = keyed.join(table, "state", "left")
    missing = F.raise_error(F.concat(F.lit("no severity ratios for state "), F.coalesce("state", F.lit("?"))))
    checked = F.when(F.col("_known").isNull(), missing.cast("double"))
    first = f"_r_{cols[0]}"
    out = joined.withColumn(first, F.coalesce(checked, F.col(first))).drop("_known")
    return out if state is None else out.drop("state")


def expand_severity(fatal: DataFrame, ratios: DataFrame, state: str | None) -> DataFrame:
    """Five severities per mode from the fatal estimate."""
    joined = with_ratios(fatal, ratios, state)
    cols = {f"est_{m}_{s}": F.col(f"est_{m}_k") * F.col(f"_r_{m}_{s}") for m in d.MODES for s in KEYS}
    return joined.withColumns(cols).drop(*[f"_r_{m}_{s}" for m in d.MODES for s in KEYS])


def nearest_segments(
    edges: DataFrame, crashes: DataFrame, fine_step, join_m: float | str, carry: list[str] = ()
) -> DataFrame:
    """Nearest fine segment on every road within reach of a crash location.

    A crash counts on each road it can reach. The nearest point's measure names the
    segment, so segment geometries are not joined; a shared border goes to the lower one.
    ``join_m`` is a number or a column that edges and crashes have, one value per study; ``carry`` names columns
    of the line to pass on.
    """
    own = _own(join_m)
    points = k.collapse_points(crashes)
    if own:
        points = points.join(edges.select("study_id", *own).distinct(), "study_id")
    placed = edges.select(*ROAD, "length_meters", *carry, *own, "m0", "x0", "y0", "x1", "y1")
    hits = within_distance(placed, points, join_m)
    at = k.segment_at(F.col("m0") + F.col("near_m"), fine_step, F.col("length_meters"))
    return k.nearest_per_road(
        hits.withColumn("fine_no", at),
        ["study_id", "x", "y", k.MODE, k.SEVERITY, "crashes"],
        ["dissolved_pkey", "length_meters", *carry],
        "fine_no",
    )


def spread_to_windows(segments: DataFrame, fine_step, step, value: str = "crashes") -> DataFrame:
    """Hand fine-segment values to short windows by overlap of the rounded measures."""
    fine_step, step = _num(fine_step), _num(step)
    length = F.col("length_meters")
    s0, s1 = step_bounds(F.col("fine_no"), fine_step, length)
    rows = segments.withColumn("_s0", s0).withColumn("_s1", s1)
    last = step_count("length_meters", step) - 1
    lo = F.least(F.greatest(F.floor(F.col("_s0") / step).cast("int") - 1, F.lit(0)), last)
    hi = F.least(F.floor(F.col("_s1") / step).cast("int") + 1, last)
    rows = rows.withColumn("segment_sequence", F.explode(F.sequence(lo, F.greatest(hi, lo))))
    w0, w1 = step_bounds(F.col("segment_sequence"), step, length)
    shared = F.least(F.col("_s1"), w1) - F.greatest(F.col("_s0"), w0)
    span = F.col("_s1") - F.col("_s0")
    return (
        rows.withColumn("_shared", shared)
        .filter(F.col("_shared") > 0)
        .withColumn(value, F.col(value) * F.col("_shared") / F.when(span != 0, span))
        .drop("_s0", "_s1", "_shared")
    )


def observed_sums(
    df: DataFrame, modes: dict[str, list[str]] | None = None, severities: dict[str, str] | None = None
) -> DataFrame:
    """Observed counts per short window, ``{mode}_{severity}_obs``, by source code lists."""
    modes = modes or {m: [m] for m in d.MODES}
    severities = severities or {s.lower(): s for s in d.SEVERITIES}
    sums = [
        F.sum(F.when(F.col(k.MODE).isin(src) & (F.col(k.SEVERITY) == code), F.col("crashes"))).alias(f"{m}_{s}_obs")
        for m, src in modes.items()
        for s, code in severities.items()
    ]
    out = df.groupBy(*SEGMENT).agg(*sums)
    return out.na.fill(0.0, [f"{m}_{s}_obs" for m in modes for s in severities])


def observed_counts(
    edges: DataFrame,
    crashes: DataFrame,
    step,
    fine_step: float = d.FINE_SEGMENT_MI * d.METERS_PER_MILE,
    join_m: float | str = d.JOIN_DISTANCE_FT * d.METERS_PER_FOOT,
    half: int = d.SMOOTH_HALF_WIDTH,
    style: str = "linear",
    modes: dict[str, list[str]] | None = None,
    severities: dict[str, str] | None = None,
) -> DataFrame:
    """Smoothed observed crashes per short window (windows without any are absent).

    ``step`` and ``join_m`` are numbers or columns of ``edges``.
    """
    line = [*ROAD, "length_meters", *_own(step)]
    nearest = nearest_segments(edges, crashes, fine_step, join_m, _own(step))
    counted = k.segment_counts(nearest, [*line, "fine_no"], "crashes")
    smooth = k.smooth_along(
        counted.withColumn("_n", step_count("length_meters", fine_step)),
        ["crashes"],
        line,
        "fine_no",
        half,
        style,
        count="_n",
        extra_keys=[k.MODE, k.SEVERITY],
    )
    return observed_sums(spread_to_windows(smooth, fine_step, step), modes, severities)


def _no_nan(col: Column) -> Column:
    # names its argument once: as a condition it would double the whole expression at every level
    return F.nanvl(col, F.lit(None).cast("double"))


def eb_update(
    prior: DataFrame,
    max_weight: float | Column = d.MAX_PRIOR_WEIGHT,
    decay: float | Column = d.PRIOR_DECAY,
    fatal_only: bool | Column = False,
) -> DataFrame:
    """Blend estimates ``est_*`` with observations ``*_obs``; adds weights ``w_*`` and posteriors ``adj_*``.

    The weight of the estimate falls with its variation. Infinite variation gives weight
    0; where weight or estimate is undefined the posterior is null. With fatal crashes only there are
    no other weights and posteriors: ``True`` leaves their columns out, a column of flags makes them null.
    """
    top, fall = _num(max_weight), _num(decay)
    by_row = isinstance(fatal_only, Column)
    out = {}
    for m in d.MODES:
        for s in KEYS if by_row or not fatal_only else KEYS[:1]:
            est, obs = F.col(f"est_{m}_{s}"), F.col(f"{m}_{s}_obs")
            w = top / F.pow(1.0 + F.col(f"{m}_cv") * est, fall)
            weight, blended = _no_nan(w), _no_nan(w * est + (1.0 - w) * obs)
            if by_row and s != KEYS[0]:
                weight, blended = F.when(~fatal_only, weight), F.when(~fatal_only, blended)
            out[f"w_{m}_{s}"] = weight
            out[f"adj_{m}_{s}"] = blended
    return prior.withColumns(out)


def crash_costs(
    posterior: DataFrame, costs: dict | str | None = None, fatal_only: bool | Column = False
) -> DataFrame:
    """Total cost per mode, ``total_{mode}_cost``; undefined if any part that counts is.

    ``costs`` maps severities to costs or names a map column; ``fatal_only`` is one flag or a column of flags.
    """
    costs = d.CRASH_COSTS if costs is None else costs
    by_row = isinstance(fatal_only, Column)
    keys = KEYS if by_row or not fatal_only else KEYS[:1]

    def part(m: str, s: str) -> Column:
        each = F.col(costs)[s.upper()].cast("double") if isinstance(costs, str) else float(costs[s.upper()])
        value = F.col(f"adj_{m}_{s}") * each
        return F.when(fatal_only, F.lit(0.0)).otherwise(value) if by_row and s != KEYS[0] else value

    return posterior.withColumns(
        {f"total_{m}_cost": sum((part(m, s) for s in keys), F.lit(0.0)) for m in d.MODES}
    )


def int_costs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{m}_cost": to_int_rounded(F.col(f"total_{m}_cost")) for m in d.MODES})
