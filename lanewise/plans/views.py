"""Map views of both analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..functions.text import pg_initcap
from ..operators.estimates import int_costs
from ..operators.filters import flag_modes
from ..operators.lrs import ROAD, cut_at_steps, window_lines
from ..operators.network import merge_lines
from ..operators.skew import shuffled


def with_lines(view: DataFrame, edges: DataFrame, step) -> DataFrame:
    """Adds the line (``geom``) of each short window of ``view``; only its windows are kept of the cut edges."""
    keys = [*ROAD, "segment_sequence"]
    pieces = cut_at_steps(edges, step).join(shuffled(view.select(*keys)), keys, "left_semi")
    return view.join(shuffled(window_lines(pieces, keys)), keys, "left")


def swa_view(short: DataFrame, edges: DataFrame | None = None, step=None) -> DataFrame:
    """Short windows with any score above zero, flags per mode, names capitalised; their lines if ``edges`` are given."""
    shown = flag_modes(short, "crash_score").withColumn("road_name", pg_initcap(F.col("road_name")))
    return shown if edges is None else with_lines(shown, edges, step)


def merge_equal_scores(edges: DataFrame, short: DataFrame, step: float, node_crossings: bool = False) -> DataFrame:
    """Stretches of road of equal name, class and scores, merged into lines edge by edge.

    ``edges`` of :func:`~lanewise.operators.network.dissolve_roads` have their crossings as nodes already;
    edges of another make need ``node_crossings``.
    """
    scored = flag_modes(short, "crash_score").select(*ROAD, "segment_sequence", *d.SCORE_COLUMNS)
    pieces = cut_at_steps(edges, step).join(shuffled(scored), [*ROAD, "segment_sequence"])
    keys = ["study_id", "road_name", "functional_class", *d.SCORE_COLUMNS]
    merged = merge_lines(pieces.withColumn("edge_no", F.lit(0)), keys, node_crossings)
    return flag_modes(merged, "crash_score").withColumn("road_name", pg_initcap(F.col("road_name")))


def cost_view(
    posterior: DataFrame, min_cost: float | Column = d.CRASH_COSTS["O"], edges: DataFrame | None = None, step=None
) -> DataFrame:
    """Segments whose cost exceeds the threshold for any mode; whole-number costs; their lines if ``edges`` are given.

    ``min_cost`` may be a column, such as the study's own cost of a crash without injury.
    """
    flagged = flag_modes(posterior, "cost", min_cost, prefix="total_")
    shown = int_costs(flagged).withColumn("road_name", pg_initcap(F.col("road_name")))
    return shown if edges is None else with_lines(shown, edges, step)
