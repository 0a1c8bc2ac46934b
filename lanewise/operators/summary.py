"""Summaries: the crash cube and the tables read from it, mileage, profiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as d
from ..functions.geometry import line_length
from .cells import within_distance
from .filters import drop_omitted, last_n_years, mapping_table
from .network import line_edges
from .skew import shuffled

STUDY = ("study_id",)
CUBE = ["crash_year", "crash_mode", "crash_severity", "functional_class"]


def nearest_road(crashes: DataFrame, roads: DataFrame, join_m: float) -> DataFrame:
    """Nearest road within reach of each crash; crashes without one keep nulls.

    Ties go to the lowest ``road_id``. Of rows that repeat a ``crash_id`` the one nearest to its road stays.
    """
    edges = line_edges(drop_omitted(roads, "functional_class").select("study_id", "road_id", "functional_class", "geom"))
    hits = within_distance(edges, crashes.select("study_id", "crash_id", "x", "y"), join_m, salt_on=("crash_id",))
    place = ["study_id", "crash_id", "x", "y"]
    best = (
        hits.groupBy(*place)
        .agg(F.min(F.struct("dist", "road_id", "functional_class")).alias("_b"))
        .select(*place, "_b.dist", "_b.road_id", "_b.functional_class")
    )
    found = crashes.join(shuffled(best), place, "left").select(*crashes.columns, "dist", "road_id", "functional_class")
    rest = [c for c in found.columns if c not in ("study_id", "crash_id")]
    nearer = F.struct(F.col("dist").isNull(), "dist", "x", "y")
    one = found.filter(F.col("crash_id").isNotNull()).groupBy("study_id", "crash_id").agg(
        F.min_by(F.struct(*rest), nearer).alias("_r")
    )
    return one.select("study_id", "crash_id", "_r.*").select(*found.columns).unionByName(
        found.filter(F.col("crash_id").isNull())
    )


def mileage_by_class(roads: DataFrame) -> DataFrame:
    miles = F.sum(line_length(F.col("geom"))) / d.METERS_PER_MILE
    return roads.groupBy("study_id", "functional_class").agg(miles.alias("mileage"))


def crash_cube(crashes: DataFrame, roads: DataFrame, join_m: float, years: int = d.STUDY_YEARS) -> DataFrame:
    """Crash counts by year, mode, severity and nearest class, with the class's mileage."""
    kept = drop_omitted(last_n_years(crashes, years), "crash_severity", "crash_mode")
    cube = nearest_road(kept, roads, join_m).groupBy("study_id", *CUBE).agg(F.count("crash_id").alias("crash_count"))
    miles = mileage_by_class(roads)
    return cube.join(miles, ["study_id", "functional_class"], "left").withColumn(
        "mileage", F.coalesce("mileage", F.lit(0.0))
    )


def order_of(col: Column, order: list) -> Column:
    """Position of a value in a fixed order; values outside it come last, nulls first."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), col)
    return F.when(col.isNull(), 0).when(place == 0, len(order) + 1).otherwise(place).cast("int")


def order_by_dim(df: DataFrame, col: str, order: list) -> DataFrame:
    return df.orderBy(order_of(F.col(col), order), F.col(col))


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """Percentage with halves rounded to even; 0 of nothing is 0."""
    return F.coalesce(F.bround(part / F.when(total != 0, total) * 100.0, digits), F.lit(0.0))


def with_total(sums: DataFrame, value: str, by: tuple) -> DataFrame:
    """Adds ``_total``: the sum of ``value`` over each study (or all rows without ``by``).

    It comes from the grouped rows, so no window gathers a study's rows in one task.
    """
    if not by:
        return sums.withColumn("_total", sums.agg(F.sum(value)).scalar())
    return sums.join(sums.groupBy(*by).agg(F.sum(value).alias("_total")), list(by))


def category_summary(cube: DataFrame, col: str, order: list, by: tuple = STUDY) -> DataFrame:
    """Crashes and share of the study's total per category, in display order."""
    sums = cube.groupBy(*by, col).agg(F.sum("crash_count").alias("total_crashes")).filter(F.col(col).isNotNull())
    shares = with_total(sums, "total_crashes", by).withColumn("percent_of_total", percent(F.col("total_crashes"), F.col("_total")))
    return shares.drop("_total").orderBy(*by, order_of(F.col(col), order), F.col(col))


def cross_tab(
    cube: DataFrame, row: str, col: str, values: list, rows: list, totals: bool = False, complete_rows: bool = False,
    names: dict | None = None, value: str = "crash_count", by: tuple = STUDY,
) -> DataFrame:
    """Rows by columns with counts per study; optional row total, percentages and an all-rows line.

    Columns are a fixed list, so the schema does not depend on the data; cells without a
    column value count nowhere.
    """
    names = names or {v: str(v) for v in values}
    kept = cube.filter(F.col(col).isNotNull() & F.col(row).isNotNull())
    sums = [
        F.coalesce(F.sum(F.when(F.col(col) == v, F.col(value))), F.lit(0)).cast("bigint").alias(names[v]) for v in values
    ]
    if not totals:
        out = kept.groupBy(*by, row).agg(*sums)
    else:
        levels = [F.grouping(c).alias(f"_every_{c}") for c in by]
        out = kept.rollup(*by, row).agg(*sums, F.grouping(row).alias("_all"), *levels)
        for c in by:  # no line over several studies
            out = out.filter(F.col(f"_every_{c}") == 0).drop(f"_every_{c}")
        out = out.withColumn(row, F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col(row))).drop("_all")
        total = sum((F.col(names[v]) for v in values), F.lit(0))
        out = out.withColumn("total", total.cast("bigint")).filter(F.col(row) != "All").unionByName(
            out.withColumn("total", total.cast("bigint")).filter((F.col(row) == "All") & (F.col("total") > 0))
        )
        out = out.withColumns({f"{names[v]}_pct": percent(F.col(names[v]), F.col("total")) for v in values})
    if complete_rows:
        each = F.explode(F.array(*[F.lit(r) for r in rows])).alias(row)
        wanted = cube.select(*by).distinct().select(*by, each) if by else cube.sparkSession.range(1).select(each)
        out = wanted.join(out, [*by, row], "left").na.fill(0, list(names.values()))
    return out.orderBy(*by, order_of(F.col(row), [*rows, "All"]), F.col(row))


def filter_options(cube: DataFrame, col: str, labels: dict[str, str], by: tuple = STUDY) -> DataFrame:
    """Codes present in each study with their labels, in the order of ``labels``."""
    dim = mapping_table(cube.sparkSession, labels).select(
        F.col("raw").alias("value"), F.col("mapped").alias("label"), "position"
    )
    present = cube.select(*by, F.col(col).alias("value")).distinct()
    return present.join(F.broadcast(dim), "value").orderBy(*by, "position")


def year_range(cube: DataFrame, by: tuple = STUDY) -> DataFrame:
    return cube.groupBy(*by).agg(F.min("crash_year").alias("min_year"), F.max("crash_year").alias("max_year"))


def observed_vs_adjusted(posterior: DataFrame, mode: str, by: tuple = STUDY) -> DataFrame:
    """Observed and blended totals per study and severity for one mode; only severities that exist."""
    have = [s for s in d.SEVERITIES if {f"{mode}_{s.lower()}_obs", f"adj_{mode}_{s.lower()}"} <= set(posterior.columns)]
    sums = posterior.groupBy(*by).agg(
        *[F.sum(F.coalesce(f"{mode}_{s.lower()}_obs", F.lit(0.0))).alias(f"o_{s}") for s in have],
        *[F.sum(F.coalesce(f"adj_{mode}_{s.lower()}", F.lit(0.0))).alias(f"a_{s}") for s in have],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("severity"),
                F.lit(d.SEVERITY_LABELS[s]).alias("label"),
                F.coalesce(F.col(f"o_{s}"), F.lit(0.0)).alias("observed"),
                F.coalesce(F.col(f"a_{s}"), F.lit(0.0)).alias("adjusted"),
            )
            for s in have
        ]
    )
    return sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def proportions(
    df: DataFrame, col: str, value: Column | None = None, name: str = "total_count", by: tuple = STUDY
) -> DataFrame:
    """Count (or sum) per category and its share of the study's total."""
    metric = F.count(F.lit(1)).cast("double") if value is None else F.coalesce(F.sum(value), F.lit(0.0))
    sums = with_total(df.groupBy(*by, col).agg(metric.alias(name)), name, by)
    total = F.col("_total")
    return sums.withColumn("proportion", F.coalesce(F.col(name) / F.when(total != 0, total), F.lit(0.0))).drop("_total")


def cost_summary(crashes: DataFrame, costs: dict[str, float], by: tuple = STUDY) -> DataFrame:
    """Unit cost, count and share per study and severity; severities without crashes show 0."""
    listed = [(s, float(costs[s])) for s in d.SEVERITIES if costs.get(s) is not None]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("crash_severity"), F.lit(c).alias("crash_cost")) for s, c in listed]))
    table = crashes.select(*by).distinct().select(*by, each.alias("c")).select(*by, "c.*")
    shares = proportions(crashes, "crash_severity", by=by)
    return table.join(shares, [*by, "crash_severity"], "left").na.fill(0.0, ["total_count", "proportion"])


def mapping_report(
    mapping: DataFrame, metric: DataFrame, standard: str, order: list | None = None, value: str = "total_count", by: tuple = STUDY
) -> DataFrame:
    """Source codes per study and standard value with its metric and share.

    Standard values without a source code stand for themselves; codes without data show 0.
    ``mapping`` is ``(raw, mapped, position)`` and is small: one row per code. ``metric`` comes from :func:`proportions`.
    """
    grouped = mapping.groupBy(F.col("mapped").alias(standard)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "raw"))), lambda r: r["raw"]), "\n").alias("_codes")
    )
    if by:  # every study gets every code
        codes = grouped.agg(F.collect_list(F.struct(standard, "_codes"))).scalar()
        grouped = metric.select(*by).distinct().select(*by, F.explode(codes).alias("c")).select(*by, "c.*")
    out = metric.join(grouped, [*by, standard], "full_outer").select(
        *by,
        F.coalesce("_codes", standard).alias("dataset_values"),
        standard,
        F.coalesce(value, F.lit(0.0)).alias(value),
        F.coalesce("proportion", F.lit(0.0)).alias("proportion"),
    )
    return out.orderBy(*by, order_of(F.col(standard), order), F.col(standard)) if order else out


def key_profile(df: DataFrame, col: str) -> DataFrame:
    """Row, distinct and null counts of a key; nulls make it not unique."""
    total, distinct, nulls = F.count(F.lit(1)), F.countDistinct(col), F.count_if(F.col(col).isNull())
    return df.agg(total.alias("total_count"), distinct.alias("unique_count"), nulls.alias("null_count")).select(
        "*",
        (F.col("total_count") == F.col("unique_count")).alias("is_unique"),
        (F.col("null_count") == 0).alias("no_nulls"),
    )


def code_profile(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed codes with counts, and lines for null and blank values."""
    text = F.col(col).cast("string")
    code = F.when(text.isNull(), F.lit(d.NULL_KEY)).when(F.trim(text) == "", F.lit(d.EMPTY_KEY)).otherwise(F.trim(text))
    return df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("code")


def missing_non_fatal(crashes: DataFrame) -> DataFrame:
    """Per study: true when no crash has a non-fatal severity."""
    non_fatal = F.col("crash_severity").isin(d.SEVERITIES[1:])
    return crashes.groupBy("study_id").agg(
        (~F.coalesce(F.max(non_fatal), F.lit(False))).alias("crash_missing_non_fatal")
    )
