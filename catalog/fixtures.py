"""Road-safety inputs derived from the given tables.

The SQL texts run unchanged in Spark and in DuckDB, so queries and their check SQL start
from the same rows; they grow with ``part``, ``orders`` and ``nation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import geometry as g

ROADS = """
SELECT 1 AS study_id, road_id,
       CASE WHEN p_size = 50 THEN NULL
            WHEN p_size = 49 THEN concat('ROW ', cast(rw AS string))
            ELSE concat('Row ', cast(rw AS string)) END AS road_name,
       CASE blk % 7 WHEN 0 THEN 'Expressway' WHEN 1 THEN 'Major Arterial' WHEN 2 THEN 'Minor Arterial'
            WHEN 3 THEN 'Major Collector' WHEN 4 THEN 'Minor Collector' WHEN 5 THEN 'Local Road'
            ELSE 'Omit From Analysis' END AS functional_class,
       cast(col * 500 AS double) AS x0,
       cast(rw * 200 AS double) AS y0,
       cast(col * 500 + CASE WHEN road_id % 5 = 0 THEN 400 WHEN col = 12 THEN 497 ELSE 500 END AS double) AS x1,
       cast(rw * 200 AS double) AS y1
FROM (SELECT p_partkey AS road_id, p_size, p_partkey % 40 AS col,
             cast((p_partkey - p_partkey % 40) / 40 AS bigint) AS rw,
             cast((p_partkey - p_partkey % 8) / 8 AS bigint) AS blk
      FROM part) t
"""

CRASHES = """
SELECT 1 AS study_id, crash_id, crash_year, crash_mode, crash_severity,
       cast((p % 40) * 500 + dx AS double) AS x,
       cast(cast((p - p % 40) / 40 AS bigint) * 200 + dy AS double) AS y
FROM (SELECT o_orderkey AS crash_id,
             CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE cast(year(o_orderdate) AS int) END AS crash_year,
             CASE WHEN o_orderkey % 10 < 3 THEN 'ped' WHEN o_orderkey % 10 < 6 THEN 'bike'
                  WHEN o_orderkey % 10 < 9 THEN 'mv' ELSE 'Omit From Analysis' END AS crash_mode,
             CASE WHEN o_orderkey % 53 = 0 THEN 'Omit From Analysis'
                  WHEN o_orderpriority LIKE '1%' THEN 'K' WHEN o_orderpriority LIKE '2%' THEN 'A'
                  WHEN o_orderpriority LIKE '3%' THEN 'B' WHEN o_orderpriority LIKE '4%' THEN 'C'
                  ELSE 'O' END AS crash_severity,
             cast((o_custkey * 4 - (o_custkey * 4) % 3) / 3 AS bigint) AS p,
             (o_orderkey * 37) % 600 - 50 AS dx,
             (o_orderkey * 13) % 31 AS dy
      FROM orders) t
"""

# Second prediction columns repeat the first pattern with other moduli.
BLOCK_GROUPS = """
SELECT 1 AS study_id, cast(n_nationkey AS string) AS geoid,
       cast((n_nationkey % 5) * 4000 AS double) AS bx0,
       cast((n_nationkey % 5) * 4000 + 4000 AS double) AS bx1,
       cast(cast((n_nationkey - n_nationkey % 5) / 5 AS bigint) * 2500 AS double) AS by0,
       cast(cast((n_nationkey - n_nationkey % 5) / 5 AS bigint) * 2500 + 2500 AS double) AS by1,
       cast(n_nationkey % 7 AS double) / 2 AS final_pred_ped,
       CASE WHEN n_nationkey % 14 = 0 THEN cast(0 AS double) ELSE cast(1 + n_nationkey % 3 AS double) / 4 END AS final_se_ped,
       cast(n_nationkey % 4 AS double) / 4 AS final_pred_bike,
       CASE WHEN n_nationkey % 8 = 0 THEN cast(0 AS double) ELSE cast(1 + n_nationkey % 5 AS double) / 8 END AS final_se_bike,
       cast(1 + n_nationkey % 9 AS double) AS final_pred_mv,
       cast(1 + n_nationkey % 2 AS double) / 2 AS final_se_mv
FROM nation
"""

RATES = """
SELECT r_name AS state, functional_class,
       cast(1 + r_regionkey + k AS double) / 1000 AS ped_fatal_rate,
       cast(1 + r_regionkey + k AS double) / 4000 AS bike_fatal_rate,
       cast(1 + r_regionkey + k AS double) / 250 AS mv_fatal_rate
FROM region CROSS JOIN (VALUES ('Expressway', 5), ('Major Arterial', 4), ('Minor Arterial', 3),
     ('Major Collector', 2), ('Minor Collector', 1)) v(functional_class, k)
"""

RATIOS = """
SELECT r_name AS state, mode, severity,
       CASE WHEN severity = 'k' THEN cast(1 AS double)
            ELSE cast((1 + r_regionkey) * w AS double) / 2 END AS ratio
FROM region CROSS JOIN (VALUES ('ped', 2), ('bike', 4), ('mv', 8)) m(mode, w)
     CROSS JOIN (VALUES ('k'), ('a'), ('b'), ('c'), ('o')) s(severity)
"""

SLANTED_ROADS = "SELECT study_id, road_id, road_name, functional_class, x0, y0 + x0 / 16 AS y0, x1, y1 + x1 / 16 AS y1 FROM fx_roads"
SLANTED_CRASHES = "SELECT study_id, crash_id, crash_year, crash_mode, crash_severity, x, y + x / 16 AS y FROM fx_crashes"

# One rectangular study area whose size follows the data; most borders avoid the grid of the roads.
AREA = """
SELECT 1 AS study_id, cast(230 AS double) AS ax0, cast(max(p_partkey) % 4000 + 14010 AS double) AS ax1,
       cast(390 AS double) AS ay0,
       cast(cast((max(p_partkey) - max(p_partkey) % 80) / 80 AS bigint) * 200 + 10 AS double) AS ay1
FROM part
"""

_SQL = {
    "fx_roads": ROADS,
    "fx_crashes": CRASHES,
    "fx_block_groups": BLOCK_GROUPS,
    "fx_rates": RATES,
    "fx_ratios": RATIOS,
    "fx_area": AREA,
    "fx_slanted_roads": SLANTED_ROADS,
    "fx_slanted_crashes": SLANTED_CRASHES,
}
_NEEDS = {"fx_slanted_roads": ["fx_roads"], "fx_slanted_crashes": ["fx_crashes"]}
BASE_TABLES = {
    "fx_roads": ["part"],
    "fx_crashes": ["orders"],
    "fx_block_groups": ["nation"],
    "fx_rates": ["region"],
    "fx_ratios": ["region"],
    "fx_area": ["part"],
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one derivation over the given tables without registering global names."""
    sources = {t: read(spark, sf_dir, t) for t in BASE_TABLES.get(name, [])}
    for parent in _NEEDS.get(name, []):
        sources[parent] = derived(spark, sf_dir, parent)
    text = _SQL[name]
    for table in sources:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **sources)


def with_lines(df: DataFrame) -> DataFrame:
    """Put the two ends of a straight road into a line column."""
    geom = F.array(g.point("x0", "y0"), g.point("x1", "y1"))
    return df.withColumn("geom", geom).drop("x0", "y0", "x1", "y1")


def roads(spark: SparkSession, sf_dir: str, slanted: bool = False) -> DataFrame:
    return with_lines(derived(spark, sf_dir, "fx_slanted_roads" if slanted else "fx_roads"))


def crashes(spark: SparkSession, sf_dir: str, slanted: bool = False) -> DataFrame:
    return derived(spark, sf_dir, "fx_slanted_crashes" if slanted else "fx_crashes")


def block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "fx_block_groups")
    return df.withColumn("rings", g.rectangle("bx0", "by0", "bx1", "by1")).drop("bx0", "bx1", "by0", "by1")


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "fx_area")
    return df.select("study_id", g.rectangle("ax0", "ay0", "ax1", "ay1").alias("rings"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "fx_rates")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "fx_ratios")


def cte(*names: str) -> str:
    """``WITH``-list entries for check SQL, parents first."""
    done: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in done:
                done.append(n)
    return ",\n".join(f"{n} AS ({_SQL[n]})" for n in done)
