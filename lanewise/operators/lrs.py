"""Linear referencing: windows along lines, cutting edges by window, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point
from .skew import shuffled

ROAD = ["study_id", "dissolved_pkey"]
# A length this close to a whole number of steps counts as whole.
NOISE_M = 1e-6


def _num(value) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(float(value))


def step_count(length, step) -> Column:
    """Number of consecutive steps needed to cover a length."""
    return F.greatest(F.ceil((_num(length) - NOISE_M) / _num(step)), F.lit(1).cast("bigint")).cast("int")


def window_count(lines: DataFrame, window, step) -> DataFrame:
    """Add ``num_windows``: one window, or as many steps as reach the end of the line."""
    window, step = _num(window), _num(step)
    beyond = F.ceil((F.col("length_meters") - window - NOISE_M) / step) + 1
    return lines.withColumn(
        "num_windows", F.when(F.col("length_meters") <= window, 1).otherwise(beyond).cast("int")
    )


def expand_series(df: DataFrame, count: Column | str, name: str = "n") -> DataFrame:
    """One row per ``0 .. count - 1``; rows with a count below one vanish."""
    count = F.col(count) if isinstance(count, str) else count
    kept = df.withColumn("_count", count.cast("int")).filter(F.col("_count") >= 1)
    return kept.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).drop("_count")


def sliding_windows(lines: DataFrame, window, step) -> DataFrame:
    """Overlapping windows ``[step*n, min(window + step*n, length)]`` along each line."""
    window, step = _num(window), _num(step)
    counted = expand_series(window_count(lines, window, step), "num_windows", "window_no")
    start = step * F.col("window_no")
    return (
        counted.withColumn("start_distance_m", start)
        .withColumn("end_distance_m", F.least(window + start, F.col("length_meters")))
        .withColumn("length", F.col("end_distance_m") - F.col("start_distance_m"))
    )


def step_bounds(seq, step, length) -> tuple[Column, Column]:
    """Start and end measure of step ``seq``, rounded to 0.1 m as stored.

    Halves go up. Plain arithmetic stays in generated code, where decimal rounding would
    create objects per row; a hundred-millionth of a metre absorbs the noise of doubles.
    """
    seq, step, length = _num(seq), _num(step), _num(length)

    def tenth(m):
        return F.floor(m * 10.0 + (0.5 + 1e-7)) / 10.0

    return tenth(step * seq), tenth(F.least(step * (seq + 1), length))


def short_windows(lines: DataFrame, step, key: str = "short_window_id") -> DataFrame:
    """Consecutive windows of one step along each line, measures rounded to 0.1 m.

    ``key`` is the line's key and the position on it, stable however the job is run.
    """
    step = _num(step)
    expanded = expand_series(
        drop_zero_length(lines, "length_meters"), step_count("length_meters", step), "segment_sequence"
    )
    start, end = step_bounds(F.col("segment_sequence"), step, F.col("length_meters"))
    return (
        expanded.withColumn("start_distance_m", start)
        .withColumn("end_distance_m", end)
        .withColumn(key, F.concat_ws("-", "dissolved_pkey", F.col("segment_sequence").cast("string")))
    )


def drop_zero_length(df: DataFrame, length: str = "length") -> DataFrame:
    return df.filter(F.col(length) > 0)


def cut_at_steps(edges: DataFrame, step) -> DataFrame:
    """Cut measured edges at every multiple of ``step``: each piece lies in one short window.

    Windows are regular, so the windows an edge meets follow from its measures; no join.
    """
    step = _num(step)
    last = step_count("length_meters", step) - 1
    lo = F.least(F.floor((F.col("m0") + NOISE_M) / step).cast("int"), last)
    hi = F.greatest(F.least(F.ceil((F.col("m1") - NOISE_M) / step).cast("int") - 1, last), lo)
    rows = edges.withColumn("segment_sequence", F.explode(F.sequence(lo, hi)))
    c0 = F.greatest(F.col("m0"), F.col("segment_sequence") * step)
    c1 = F.when(F.col("segment_sequence") == hi, F.col("m1")).otherwise(
        F.least(F.col("m1"), (F.col("segment_sequence") + 1) * step)
    )
    rows = rows.withColumn("_c0", c0).withColumn("_c1", c1)
    span = F.col("m1") - F.col("m0")
    t0, t1 = (F.col("_c0") - F.col("m0")) / span, (F.col("_c1") - F.col("m0")) / span
    at = [
        F.when(t == 0, F.col(f"{a}0")).when(t == 1, F.col(f"{a}1")).otherwise(
            F.col(f"{a}0") + t * (F.col(f"{a}1") - F.col(f"{a}0"))
        ).alias(name)
        for t, a, name in ((t0, "x", "_x0"), (t0, "y", "_y0"), (t1, "x", "_x1"), (t1, "y", "_y1"))
    ]
    keep = [c for c in rows.columns if c not in {"x0", "y0", "x1", "y1", "m0", "m1", "_c0", "_c1"}]
    return rows.select(*keep, F.col("_c0").alias("m0"), F.col("_c1").alias("m1"), *at).withColumnsRenamed(
        {"_x0": "x0", "_y0": "y0", "_x1": "x1", "_y1": "y1"}
    )


def window_lines(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Line geometry per window from its pieces; a window is short, so its list is too."""
    return (
        pieces.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("m0", "x0", "y0", "x1", "y1"))).alias("_p"))
        .withColumn(
            "geom",
            F.concat(
                F.transform("_p", lambda e: point(e["x0"], e["y0"])),
                F.array(point(F.element_at("_p", -1)["x1"], F.element_at("_p", -1)["y1"])),
            ),
        )
        .drop("_p")
    )


def range_lines(
    ranges: DataFrame, edges: DataFrame, keys: list[str], start: str = "start_distance_m", end: str = "end_distance_m", bucket: float = 1000.0
) -> DataFrame:
    """Geometry of measured stretches: ``keys`` and ``geom``.

    ``keys`` (the line's key among them) name a stretch. Stretches and edges meet on (line, measure bucket), so a
    long line spreads over many keys; an edge counts in the bucket where it and the stretch first meet.
    Only the rows of ``ranges`` are cut, so pass the ones that are kept.
    """
    wanted = ranges.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to"))
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    parts = edges.select(*ROAD, "m0", "m1", "x0", "y0", "x1", "y1").withColumn("_bucket", buckets("m0", "m1"))
    met = wanted.withColumn("_bucket", buckets("_from", "_to")).join(shuffled(parts), [*ROAD, "_bucket"])
    lo, hi = F.greatest("m0", "_from"), F.least("m1", "_to")
    inside = met.filter((hi - lo > NOISE_M) & (F.floor(lo / bucket) == F.col("_bucket")))
    span = F.col("m1") - F.col("m0")

    def at(axis, m):
        return F.when(m == F.col("m0"), F.col(f"{axis}0")).when(m == F.col("m1"), F.col(f"{axis}1")).otherwise(
            F.col(f"{axis}0") + (m - F.col("m0")) / span * (F.col(f"{axis}1") - F.col(f"{axis}0"))
        )

    cut = inside.select(
        *keys, lo.alias("m0"), at("x", lo).alias("x0"), at("y", lo).alias("y0"), at("x", hi).alias("x1"), at("y", hi).alias("y1")
    )
    return window_lines(cut, keys)


def lrs_overlap(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    min_overlap: float = 0.0,
    bucket: float = 1000.0,
    start: str = "start_distance_m",
    end: str = "end_distance_m",
) -> DataFrame:
    """Pairs of intervals on the same line that overlap, with ``overlap`` in metres.

    With ``min_overlap`` 0 the overlap must be positive, else at least ``min_overlap``. Both
    sides are listed under the measure buckets they touch and joined on (line, bucket); a pair
    is kept in the bucket where its overlap starts, so it comes out once. A very long line
    spreads over many buckets and never becomes one hot key. Columns of ``right`` other
    than the key get the suffix ``_r``.
    """

    def listed(df):
        lo = F.floor(F.col(start) / bucket)
        return df.withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(F.floor(F.col(end) / bucket), lo))))

    other = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c not in key})
    other = other.withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col(f"{start}_r") / bucket),
        F.greatest(F.floor(F.col(f"{end}_r") / bucket), F.floor(F.col(f"{start}_r") / bucket)),
    )))
    from_m = F.greatest(F.col(start), F.col(f"{start}_r"))
    overlap = F.least(F.col(end), F.col(f"{end}_r")) - from_m
    pairs = listed(left).join(shuffled(other), [*key, "_bucket"]).withColumn("overlap", overlap)
    enough = F.col("overlap") >= min_overlap if min_overlap > 0 else F.col("overlap") > 0
    return pairs.filter(enough & (F.floor(from_m / bucket) == F.col("_bucket"))).drop("_bucket")
