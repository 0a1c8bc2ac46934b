"""Result tables, portable exports, GeoJSON and summary CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import domain as d
from ..operators.summary import order_of
from ..session import cut_lineage


def write_result(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Replace the results of the studies present in ``df``; other studies stay.

    With ``key``, a repeated or missing key fails the write before anything is replaced. The rows
    are computed once: what is checked is what is written.
    """
    if key:
        df = cut_lineage(df)
        keys = ["study_id", *key]
        missing = F.lit(False)
        for c in keys:
            missing = missing | F.col(c).isNull()
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | missing)
        if not twice.isEmpty():
            raise ValueError(f"key {keys} is not unique")
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("study_id")
        .parquet(path)
    )


def export_view(
    df: DataFrame,
    columns: list[str] | None = None,
    where: Column | None = None,
    separator: str = ",",
    digits: dict[str, int] | None = None,
    multi: str | None = None,
) -> DataFrame:
    """Cast to types every GIS format takes.

    Booleans become 1/0, arrays joined text ('' when null), maps and structs JSON text,
    chosen numbers are rounded, and a line or polygon column (``multi``) is wrapped as multi-part.
    """
    digits = digits or {}
    wanted = list(dict.fromkeys(columns)) if columns else df.columns
    fields = {f.name: f.dataType for f in df.schema}

    def cast(name: str) -> Column:
        kind, col = fields[name], F.col(name)
        if name == multi:
            return F.array(col)
        if isinstance(kind, T.BooleanType):
            return col.cast("int")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_join(col.cast("array<string>"), separator), F.lit(""))
        if isinstance(kind, (T.MapType, T.StructType)):
            return F.to_json(col)
        if isinstance(kind, (T.CharType, T.VarcharType)):
            return col.cast("string")
        if name in digits:
            return F.round(col.cast("decimal(28,10)"), digits[name])
        return col

    rows = df if where is None else df.filter(where)
    return rows.select(*[cast(c).alias(c) for c in wanted if c in fields])


def point_geometry(x: str = "lon", y: str = "lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def line_geometry(geom: str = "geom") -> Column:
    return F.struct(
        F.lit("LineString").alias("type"), F.transform(geom, lambda p: F.array(p["x"], p["y"])).alias("coordinates")
    )


def polygon_geometry(rings: str = "rings") -> Column:
    closed = F.transform(rings, lambda r: F.concat(
        F.transform(r, lambda p: F.array(p["x"], p["y"])),
        F.when(F.element_at(r, 1) != F.element_at(r, -1),
               F.array(F.array(F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]))).otherwise(
                   F.array().cast("array<array<double>>")),
    ))
    return F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))


def to_geojson(df: DataFrame, geometry: Column, props: dict[str, str], draw_order: list[Column] = ()) -> DataFrame:
    """One GeoJSON feature per row, in column ``feature``; sorted so the last is drawn on top."""
    body = F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct(*[F.col(c).alias(n) for n, c in props.items()]).alias("properties"),
    )
    rows = df.orderBy(*draw_order) if draw_order else df
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def severity_draw_order(col: str = "crash_severity") -> Column:
    """Least severe first, so fatal crashes end on top."""
    return order_of(F.col(col), list(reversed(d.SEVERITIES)))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file; the rows are made in parallel and only their writing is one task."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)
