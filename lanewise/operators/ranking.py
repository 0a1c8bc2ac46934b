"""Top lists and priority flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..functions.text import pg_initcap
from .lrs import ROAD, range_lines
from .skew import key_sizes, salted_join, top_per_group


def best_per_road(sliding: DataFrame, mode: str) -> DataFrame:
    """Best window per road name and class: highest score, then longest.

    A maximum over a struct combines map-side, so the large group of unnamed roads is
    never gathered or sorted. Remaining ties go to the smallest line key and window.
    """
    score = F.col(d.score_column(mode))
    best = F.min(
        F.struct(
            (-score).alias("neg_score"),
            (-F.col("length")).alias("neg_length"),
            "dissolved_pkey",
            "window_no",
            "start_distance_m",
            "end_distance_m",
        )
    )
    return (
        sliding.filter(score > 0)
        .groupBy("study_id", "road_name", "functional_class")
        .agg(best.alias("_b"))
        .select(
            "study_id",
            "road_name",
            "functional_class",
            (-F.col("_b.neg_score")).alias("crash_score"),
            (-F.col("_b.neg_length")).alias("length"),
            *[f"_b.{c}" for c in ("dissolved_pkey", "window_no", "start_distance_m", "end_distance_m")],
        )
    )


def top_corridors(
    sliding: DataFrame, mode: str, n: int = d.TOP_STREETS, edges: DataFrame | None = None, studies: DataFrame | None = None
) -> DataFrame:
    """The ``n`` best corridors of each study by score, then length; names capitalised.

    With the stitched ``edges``, each corridor carries its line in ``geom``. ``studies`` (``study_id``, ``top_streets_threshold``) gives
    each study a number of its own; ``n`` holds for studies that it lacks and for nulls.
    """
    best = best_per_road(sliding, mode)
    order = [F.desc("crash_score"), F.desc("length"), F.asc_nulls_last("road_name"), F.asc("functional_class")]
    most = n
    if studies is not None:
        own = studies.select("study_id", F.coalesce("top_streets_threshold", F.lit(n)).alias("_n"))
        best = salted_join(best, own, ["study_id"], ["road_name", "functional_class"], "left")
        most = F.coalesce("_n", F.lit(n))
    top = top_per_group(best, ["study_id"], order, most, ["road_name", "functional_class"]).drop("_n")
    if edges is not None:
        keys = [*ROAD, "window_no"]
        top = top.join(range_lines(top, edges, keys), keys, "left")
    return top.withColumn("road_name", pg_initcap(F.col("road_name")))


def top_segments(costs: DataFrame, mode: str, n: int = d.TOP_STREETS) -> DataFrame:
    """The ``n`` most expensive segments of one mode in each study."""
    col = f"{mode}_cost"
    shown = costs.filter(F.col(f"show_{mode}")).select("study_id", "road_name", "functional_class", col, "short_window_id")
    order = [F.desc(col), F.asc("short_window_id")]
    return top_per_group(shown, ["study_id"], order, n, ["short_window_id"]).drop("rank").orderBy("study_id", *order)


def latest(crashes: DataFrame, n: int = d.PRIORITY_MARKERS) -> DataFrame:
    """The ``n`` latest crashes of each study, years missing last."""
    order = [F.desc_nulls_last("crash_year"), F.desc("crash_id")]
    return top_per_group(crashes, ["study_id"], order, n, ["crash_id"]).drop("rank").orderBy("study_id", *order)


def priority_flag(crashes: DataFrame, n: int = d.PRIORITY_MARKERS) -> DataFrame:
    """Flag the ``n`` latest crashes per mode and add the mode's total.

    Only the ``n``-th row per mode is looked for; the flag of every crash is then one
    comparison with it, so no task ranks a whole mode.
    """
    keys = ["study_id", "crash_mode"]
    order = [F.desc_nulls_last("crash_year"), F.desc("crash_id")]
    place = F.struct(F.coalesce("crash_year", F.lit(-(2**31))).alias("y"), F.col("crash_id").alias("i"))
    top = top_per_group(crashes.select(*keys, "crash_year", "crash_id"), keys, order, n, ["crash_id"])
    cuts = top.groupBy(*keys).agg(F.min(place).alias("_cut"))
    totals = key_sizes(crashes, keys)
    marks = cuts.join(totals.withColumnRenamed("_rows", "mode_total"), keys)
    return (
        salted_join(crashes, marks, keys, ["crash_id"], sizes=totals)
        .withColumn("priority", place >= F.col("_cut"))
        .drop("_cut")
    )
