"""Row filters and recodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as d


def drop_omitted(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows marked as omitted in any of the columns; nulls go too."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) != d.OMIT for c in cols]))


def last_n_years(df: DataFrame, n: int = d.STUDY_YEARS, year: str = "crash_year", by=("study_id",)) -> DataFrame:
    """Rows of the last ``n`` years, counted back from the latest year among all rows of the study.

    Rows without a year are dropped.
    """
    if not by:
        return df.filter(F.col(year) > df.agg(F.max(year)).scalar() - n)
    latest = df.groupBy(*by).agg(F.max(year).alias("_latest"))
    return df.join(latest, list(by)).filter(F.col(year) > F.col("_latest") - n).drop("_latest")


def keep_domain(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """Keep rows whose columns hold listed values."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isin(list(v)) for c, v in domains.items()]))


def slice_cube(cube: DataFrame, y0=None, y1=None, mode: str | None = None, severity: str | None = None) -> DataFrame:
    """Year range and optional mode / severity selection, both ends inclusive."""
    out = cube
    if y0 is not None:
        out = out.filter(F.col("crash_year") >= int(y0))
    if y1 is not None:
        out = out.filter(F.col("crash_year") <= int(y1))
    if mode is not None:
        out = out.filter(F.col("crash_mode") == mode)
    if severity is not None:
        out = out.filter(F.col("crash_severity") == severity)
    return out


def flag_modes(df: DataFrame, suffix: str, threshold: float | Column = 0, prefix: str = "") -> DataFrame:
    """Add ``show_{mode}`` where a mode's value exceeds the threshold (a number or column); keep rows with any flag."""
    flags = {
        f"show_{m}": F.coalesce(F.col(f"{prefix}{m}_{suffix}"), F.lit(0)) > threshold for m in d.MODES
    }
    return df.withColumns(flags).filter(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def mapping_table(spark, mapping: dict[str, str]) -> DataFrame:
    """Code map as rows ``(raw, mapped, position)``."""
    rows = [(k, v, i) for i, (k, v) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "raw string, mapped string, position int")


def recode_expr(col: Column, mapping: dict[str, str], else_value: str | None = None, trim: bool = False) -> Column:
    """Recode in map order, with arms for null and blank values and a default."""
    value = F.trim(col) if trim else col
    out = None
    for raw, mapped in mapping.items():
        test = (
            col.isNull() if raw == d.NULL_KEY else F.trim(col) == "" if raw == d.EMPTY_KEY else value == raw
        )
        out = F.when(test, F.lit(mapped)) if out is None else out.when(test, F.lit(mapped))
    if out is None:
        return F.lit(else_value)
    return out.otherwise(F.lit(else_value))


def recode(
    df: DataFrame, col: str, mapping: dict[str, str] | DataFrame, else_value: str | None = None,
    trim: bool = False, into: str | None = None,
) -> DataFrame:
    """Recode a column by a code map: a dict becomes one expression, a DataFrame a join."""
    into = into or col
    if isinstance(mapping, dict):
        return df.withColumn(into, recode_expr(F.col(col), mapping, else_value, trim))
    key = F.trim(F.col(col)) if trim else F.col(col)
    arm = (
        F.when(F.col(col).isNull(), F.lit(d.NULL_KEY)).when(F.trim(F.col(col)) == "", F.lit(d.EMPTY_KEY)).otherwise(key)
    )
    codes = mapping.select(F.col("raw").alias("_arm"), F.col("mapped").alias("_mapped"))
    return (
        df.withColumn("_arm", arm)
        .join(codes, "_arm", "left")
        .withColumn(into, F.coalesce("_mapped", F.lit(else_value)))
        .drop("_arm", "_mapped")
    )


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def label(df: DataFrame, col: str, labels: dict[str, str], into: str) -> DataFrame:
    """Display label of a code; unknown codes stay as they are."""
    pairs = [F.lit(v) for kv in labels.items() for v in kv]
    return df.withColumn(into, F.coalesce(F.element_at(F.create_map(*pairs), F.col(col)), F.col(col)))
