"""Registry of queries and their check SQL, plus state shared by queries of one session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewise.operators.network import dissolve_roads
from lanewise.plans.swa import SwaParams, score_windows
from lanewise.session import cut_lineage

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL the driver checks rows only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_edges: dict[tuple, DataFrame] = {}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitched roads, written once per session and folder as an analysis would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _edges:
        _edges[key] = cut_lineage(dissolve_roads(fx.roads(spark, sf_dir)))
    return _edges[key]


def screening(spark: SparkSession, sf_dir: str, params: SwaParams = SwaParams()):
    """Lines, sliding and short windows over the stitched roads."""
    return score_windows(edges(spark, sf_dir), fx.crashes(spark, sf_dir), params)


def forget() -> None:
    """Drop the shared stitched roads, so the next use stitches again."""
    _edges.clear()
