"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 100_000
HOT_ROWS = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled whatever its estimated size.

    Estimates start from compressed files and know nothing of explodes, so a side that grows with the
    data can pass for a small one, and broadcasting it takes it whole through the driver.
    """
    return df.hint("merge")


def key_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, combined map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def hot_keys(sizes: DataFrame, keys: list[str], most: int, rows: int) -> DataFrame:
    """All keys with more than ``rows`` rows and more than ``1/most`` of all rows, and how many ways to split each.

    By counting, fewer than ``most`` keys can hold more than that share, which is what makes
    broadcasting the list safe; no key is cut off.
    """
    total = sizes.agg(F.sum("_rows")).scalar()
    return sizes.filter(F.col("_rows") > F.greatest(F.lit(float(rows)), total / float(most))).select(
        *keys, F.ceil(F.col("_rows") / float(rows)).cast("int").alias("_splits")
    )


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    salt_on: list[str],
    how: str = "inner",
    residual: Column | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which hot keys of ``many`` are spread over several tasks.

    Rows of ``many`` under a hot key get a salt from a hash of ``salt_on`` (stable columns,
    so a re-run task writes the same rows); rows of ``few`` are copied once per salt of
    their key. Ordinary keys keep salt 0 on both sides and are not copied. Neither side is broadcast. ``sizes`` may pass
    row counts per key (``_rows``) that are at hand, which saves the counting pass.
    """
    counted = key_sizes(many, keys) if sizes is None else sizes
    hot = F.broadcast(hot_keys(counted, keys, HOT_KEYS, HOT_ROWS))
    left = many.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*salt_on), F.col("_splits").cast("bigint")).cast("int")
        ),
    )
    right = few.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    ).drop("_splits")
    left = left.drop("_splits")
    if how == "left_semi" and residual is not None:
        right = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_salt"]})
        match = residual
        for k in [*keys, "_salt"]:
            match = match & (F.col(k) == F.col(f"_r_{k}"))
        return left.join(shuffled(right), match, "left_semi").drop("_salt")
    joined = left.join(shuffled(right), [*keys, "_salt"], how).drop("_salt")
    return joined if residual is None else joined.filter(residual)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int | Column, spread_on: list[str], ways: int = 64
) -> DataFrame:
    """First ``n`` rows per key in two rounds, exact, with no task seeing a whole group.

    Round one ranks inside ``ways`` hash slices of each key, so the final ranking gets at
    most ``ways * n`` rows per key. Spark prunes both rounds before their shuffles where ``n`` is a number; it may
    be a column that is the same in all rows of a key.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_on), F.lit(ways)))
    first = sliced.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    ).filter(F.col("_rank") <= n)
    return (
        first.drop("_rank", "_slice")
        .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("rank") <= n)
    )
