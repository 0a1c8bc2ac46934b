"""Feature datasets: GeoJSON, Parquet and CSV into points, lines and polygons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection as p

GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{GEOMETRY}>"


@dataclass(frozen=True)
class Features:
    """Usable rows (with ``geom_type`` and ``coordinates``) and rejected rows with a ``reason``."""

    rows: DataFrame
    rejects: DataFrame


def read_features(
    spark: SparkSession,
    path: str,
    fmt: str = "geojsonl",
    crs: int | None = 4326,
    geom_types: list[str] = (),
    properties: list[str] = (),
) -> Features:
    """Read features and set aside rows without a geometry or of another type.

    ``geojsonl`` has one feature per line and splits across tasks; use it for large input. ``geojson`` is one
    collection per file, which one task reads whole. ``parquet`` and ``csv`` need ``geometry`` as GeoJSON text or
    ``lon``/``lat`` columns. A dataset without a coordinate system is refused.
    """
    if crs is None:
        raise ValueError("the feature dataset has no coordinate system")
    if fmt == "geojsonl":
        return parse_features(spark.read.text(path), crs, geom_types, properties)
    if fmt == "geojson":
        raw = spark.read.schema(f"features array<{FEATURE}>").json(path, multiLine=True).select(
            F.explode("features").alias("f")
        )
    else:
        table = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, header=True)
        return check_features(_with_geometry(table), geom_types, crs)
    return check_features(_flat(raw, properties), geom_types, crs)


def parse_features(
    texts: DataFrame, crs: int = 4326, geom_types: list[str] = (), properties: list[str] = (), text_col: str = "value"
) -> Features:
    """Features of rows that hold one GeoJSON feature each; text that is none is rejected without properties."""
    return check_features(_flat(texts.select(F.from_json(text_col, FEATURE).alias("f")), properties), geom_types, crs)


def _flat(raw: DataFrame, properties: list[str]) -> DataFrame:
    return raw.select(
        *[F.element_at("f.properties", F.lit(n)).alias(n) for n in properties],
        F.col("f.geometry.type").alias("geom_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def _with_geometry(table: DataFrame) -> DataFrame:
    if "geometry" in table.columns:
        parsed = table.withColumn("_g", F.from_json("geometry", GEOMETRY))
        return parsed.withColumn("geom_type", F.col("_g.type")).withColumn(
            "coordinates", F.col("_g.coordinates")
        ).drop("_g", "geometry")
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    return (
        table.withColumn("geom_type", F.when(lon.isNotNull() & lat.isNotNull(), F.lit("Point")))
        .withColumn("coordinates", F.to_json(F.array(lon, lat)))
        .drop("lon", "lat")
    )


def check_features(flat: DataFrame, geom_types: list[str], crs: int = 4326) -> Features:
    empty = F.col("geom_type").isNull() | F.col("coordinates").isNull() | (F.col("coordinates") == "[]")
    wrong = ~F.col("geom_type").isin(list(geom_types)) if geom_types else F.lit(False)
    marked = flat.withColumn(
        "reason", F.when(empty, F.lit("no geometry")).when(wrong, F.lit("geometry type not allowed"))
    ).withColumn("crs", F.lit(crs))
    return Features(
        marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
    )


def _vertex(c: Column) -> Column:
    return F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))


def points(features: DataFrame) -> DataFrame:
    c = F.from_json("coordinates", "array<double>")
    return features.select("*", F.get(c, 0).alias("lon"), F.get(c, 1).alias("lat")).drop("coordinates", "geom_type")


def lines(features: DataFrame) -> DataFrame:
    """One row per line; the parts of a MultiLineString become rows with ``part``."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geom_type") == "LineString", one).otherwise(many)
    rows = features.select("*", F.posexplode(parts).alias("part", "_c")).drop("coordinates", "geom_type")
    return rows.withColumn("geom", F.transform("_c", _vertex)).drop("_c")


def polygons(features: DataFrame) -> DataFrame:
    """One row per polygon; the parts of a MultiPolygon share the feature's columns."""
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geom_type") == "Polygon", one).otherwise(many)
    rows = features.select("*", F.posexplode(parts).alias("part", "_c")).drop("coordinates", "geom_type")
    return rows.withColumn("rings", F.transform("_c", lambda r: F.transform(r, _vertex))).drop("_c")


def project(df: DataFrame, zone: Column | int) -> DataFrame:
    """Project longitude/latitude columns (``lon, lat``, ``geom`` or ``rings``) to one UTM zone."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    out = df
    if "lon" in df.columns:
        out = out.withColumn("_p", p.to_utm(F.col("lon"), F.col("lat"), zone))
        out = out.withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")
    if "geom" in df.columns:
        out = out.withColumn("geom", p.line_to_utm(F.col("geom"), zone))
    if "rings" in df.columns:
        out = out.withColumn("rings", p.polygon_to_utm(F.col("rings"), zone))
    return out.withColumn("crs", (F.lit(32600) + zone).cast("int"))


def area_frame(area: DataFrame) -> DataFrame:
    """Centre, bounding box and UTM code of each longitude/latitude study area."""
    m = g.moments(F.col("rings"))
    box = g.bbox(F.element_at("rings", 1))
    parts = area.select("study_id", m.alias("m"), box.alias("b"))
    lon, lat = F.col("mx") / F.col("a"), F.col("my") / F.col("a")
    return (
        parts.groupBy("study_id")
        .agg(
            *[F.sum(f"m.{c}").alias(c) for c in ("a", "mx", "my")],
            F.min("b.xmin").alias("xmin"),
            F.min("b.ymin").alias("ymin"),
            F.max("b.xmax").alias("xmax"),
            F.max("b.ymax").alias("ymax"),
        )
        .withColumn("lon", lon)
        .withColumn("lat", lat)
        .withColumn("crs", p.utm_epsg(F.col("lon"), F.col("lat")))
        .drop("a", "mx", "my")
    )
