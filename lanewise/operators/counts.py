"""Crash counts: per window, per segment, smoothed along roads, spread to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from .lrs import NOISE_M, ROAD, _num, step_bounds, step_count
from .skew import shuffled

MODE, SEVERITY = "crash_mode", "crash_severity"


def collapse_points(crashes: DataFrame) -> DataFrame:
    """One row per study, place, mode and severity with ``crashes``.

    Many reports geocoded to one place become one point before any join.
    """
    return crashes.groupBy("study_id", "x", "y", MODE, SEVERITY).agg(F.count(F.lit(1)).alias("crashes"))


def windows_reached(hits: DataFrame, window, step) -> DataFrame:
    """Windows whose stretch of road comes within the join distance of a point.

    ``hits`` pairs points with measured edges (:func:`~.cells.within_distance`); the reach along the
    edge gives a range of window numbers, so window geometries are never joined. A point that
    reaches one window over several edges counts once.
    """
    window, step = _num(window), _num(step)
    lo_m, hi_m = F.col("m0") + F.col("reach_lo"), F.col("m0") + F.col("reach_hi")
    last = F.when(F.col("length_meters") <= window, F.lit(0)).otherwise(
        F.ceil((F.col("length_meters") - window - NOISE_M) / step)
    ).cast("int")
    hi = F.least(F.floor((hi_m + 1e-9) / step).cast("int"), last)
    lo = F.least(F.greatest(F.ceil((lo_m - window - 1e-9) / step).cast("int"), F.lit(0)), last)
    return hits.withColumn("_lo", lo).withColumn("_hi", F.greatest(hi, F.col("_lo"))).withColumn(
        "window_no", F.explode(F.sequence("_lo", "_hi"))
    ).drop("_lo", "_hi")


def mode_severity_sums(value: Column, modes=tuple(d.MODES), severities=tuple(d.SEVERITIES)) -> list[Column]:
    """Conditional sums, one column per mode and severity; combined map-side by Spark."""
    return [
        F.sum(F.when((F.col(MODE) == m) & (F.col(SEVERITY) == s), value)).alias(d.count_column(m, s))
        for m in modes
        for s in severities
    ]


def window_counts(reached: DataFrame, keys: list[str], value: str = "crashes") -> DataFrame:
    """Counts per window, mode and severity (15 columns, zero where nothing was found)."""
    sums = reached.groupBy(*keys).agg(*mode_severity_sums(F.col(value)))
    return sums.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in d.COUNT_COLUMNS])


def window_scores(counts: DataFrame, weights: dict | str | None = None) -> DataFrame:
    """Weighted score per mode; ``weights`` is a map of severity to weight or a MAP column."""
    weights = d.CRASH_WEIGHTS if weights is None else weights

    def weight(s):
        return F.element_at(weights, F.lit(s)) if isinstance(weights, str) else F.lit(weights[s])

    out = counts
    for m in d.MODES:
        score = sum((F.col(d.count_column(m, s)) * weight(s) for s in d.SEVERITIES), F.lit(0))
        out = out.withColumn(d.score_column(m), score.cast("int"))
    return out


def max_overlapping_score(scored: DataFrame, step, min_overlap: float = 1.0) -> DataFrame:
    """Highest score per mode over the sliding windows that overlap each short window.

    ``scored`` holds sliding windows with a score above zero. The short windows one overlaps follow
    from its measures, so this is an expansion and one aggregation, not an interval join.
    """
    step = _num(step)
    last = step_count("length_meters", step) - 1
    lo = F.greatest(F.floor(F.col("start_distance_m") / step).cast("int") - 1, F.lit(0))
    hi = F.least(F.floor(F.col("end_distance_m") / step).cast("int") + 1, last)
    rows = scored.withColumn("segment_sequence", F.explode(F.sequence(lo, F.greatest(hi, lo))))
    start, end = step_bounds(F.col("segment_sequence"), step, F.col("length_meters"))
    shared = F.least(end, F.col("end_distance_m")) - F.greatest(start, F.col("start_distance_m"))
    return (
        rows.filter(shared >= min_overlap)
        .groupBy(*ROAD, "segment_sequence")
        .agg(*[F.max(c).alias(c) for c in d.SCORE_COLUMNS])
    )


def nearest_per_road(
    hits: DataFrame, point_keys: list[str], road_keys: list[str], place: str, carry: list[str] = ()
) -> DataFrame:
    """Keep, for every point and road, the nearest hit; ties go to the lowest ``place``."""
    best = F.min(F.struct(F.col("dist"), F.col(place), *[F.col(c) for c in carry])).alias("_best")
    return hits.groupBy(*point_keys, *road_keys).agg(best).select(*point_keys, *road_keys, "_best.*")


def segment_at(measure: Column, step, length) -> Column:
    """Number of the step holding a measure; a shared border belongs to the lower step."""
    step = _num(step)
    raw = F.ceil((measure - 1e-9) / step).cast("int") - 1
    return F.least(F.greatest(raw, F.lit(0)), step_count(length, step) - 1)


def segment_counts(nearest: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Counts per segment, mode and severity in long form; segments without crashes are absent."""
    total = F.sum(value) if value else F.count(F.lit(1))
    return nearest.groupBy(*keys, MODE, SEVERITY).agg(total.cast("double").alias("crashes"))


def kernel(half: int, style: str = "linear") -> list[float]:
    """Raw weights at offsets ``-half .. half``."""
    if style == "linear":
        return [(half + 1 - abs(k)) / (half + 1) for k in range(-half, half + 1)]
    if style == "uniform":
        return [1.0] * (2 * half + 1)
    raise ValueError(f"unknown kernel style: {style!r}")


def kernel_norm(seq: Column, count: Column, half: int, style: str) -> Column:
    """Sum of the kernel weights that fall on the road around position ``seq``."""
    weights = kernel(half, style)
    inside = [
        F.when((seq + k >= 0) & (seq + k < count), F.lit(w)).otherwise(F.lit(0.0))
        for k, w in zip(range(-half, half + 1), weights)
    ]
    return sum(inside[1:], inside[0])


def smooth_along(
    df: DataFrame,
    value_cols: list[str],
    key: list[str],
    seq: str,
    half: int = d.SMOOTH_HALF_WIDTH,
    style: str = "linear",
    count: str | None = None,
    extra_keys: list[str] = (),
) -> DataFrame:
    """Spread each value over its neighbours along the road, keeping the road's total.

    Weights are truncated at road ends and scaled per source so nothing is lost. Every source
    row sends its shares to the positions around it and the shares are summed per
    position: the shuffle key includes the position, so one very long road is spread over
    all tasks. ``count`` names the column with the road's number of segments; without it the
    rows of a road are counted. Rows whose values are all zero need not be present when
    ``count`` is given, and come back only if they receive a share.
    """
    if half == 0:
        return df
    keys = [*key, *extra_keys]
    rows = df
    if count is None:
        rows = df.join(shuffled(df.groupBy(*key).agg(F.countDistinct(seq).alias("_count"))), key)
        count = "_count"
    offsets = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-half, half + 1), kernel(half, style))]
    )
    sent = (
        rows.withColumn("_norm", kernel_norm(F.col(seq), F.col(count), half, style))
        .withColumn("_o", F.explode(offsets))
        .withColumn("_to", F.col(seq) + F.col("_o.k"))
        .filter((F.col("_to") >= 0) & (F.col("_to") < F.col(count)))
    )
    carried = [count] if count != "_count" else []
    return (
        sent.select(
            *keys,
            F.col("_to").alias(seq),
            *carried,
            *[(F.col(c) * F.col("_o.w") / F.col("_norm")).alias(c) for c in value_cols],
        )
        .groupBy(*keys, seq, *carried)
        .agg(*[F.sum(c).alias(c) for c in value_cols])
    )


def proportional_sum(
    pairs: DataFrame, value_cols: list[str], key: list[str], start="start_distance_m", end="end_distance_m"
) -> DataFrame:
    """Sum values into windows by the share of each segment's length that overlaps.

    ``pairs`` is :func:`~.lrs.lrs_overlap` of segments (left) and windows (right).
    """
    span = F.col(end) - F.col(start)
    share = F.col("overlap") / F.when(span != 0, span)
    return pairs.groupBy(*key).agg(*[F.sum(F.col(c) * share).alias(c) for c in value_cols])


def left_fill(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], fill=0) -> DataFrame:
    """Left join that fills the named columns where nothing matched."""
    joined = left.join(shuffled(right), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in cols})
