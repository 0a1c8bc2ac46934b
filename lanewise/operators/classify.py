"""Natural-breaks classes for maps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

DIGITS = 3


def _solver(group: list[str], k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function from one group's pooled values (v, top, n) to its class limits.

    It imports what it needs, so that workers run it without this package.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("v")
        v, top, n = (pdf[c].to_numpy(dtype=float) for c in ("v", "top", "n"))
        size = len(v)
        weight, first, second = (np.concatenate([[0.0], np.cumsum(a)]) for a in (n, n * v, n * v * v))

        def spread(i, j):
            """Squared deviation from the mean within the values i to j - 1."""
            held = weight[j] - weight[i]
            return second[j] - second[i] - (first[j] - first[i]) ** 2 / np.where(held > 0, held, 1.0)

        # best[j]: least spread of the first j values in the classes so far. The best last class of j
        # values never starts before that of fewer values, so halving the ends halves the starts to try.
        best = spread(np.zeros(size + 1, int), np.arange(size + 1))
        starts = []
        for c in range(2, min(k, size) + 1):
            after, start = np.full(size + 1, np.inf), np.zeros(size + 1, int)
            todo = [(c, size, c - 1, size - 1)]
            while todo:
                low, high, least, most = todo.pop()
                if low > high:
                    continue
                j = (low + high) // 2
                i = np.arange(least, min(most, j - 1) + 1)
                total = best[i] + spread(i, j)
                at = int(np.argmin(total))
                after[j], start[j] = total[at], i[at]
                todo += [(low, j - 1, least, start[j]), (j + 1, high, start[j], most)]
            best = after
            starts.append(start)
        ends = [size]
        for start in reversed(starts):
            ends.append(int(start[ends[-1]]))
        limits = sorted(float(top[e - 1]) for e in ends)
        # maxima of classes differ; only the lowest value can be a maximum as well
        lowest = float(pdf["_low"].iloc[0])
        if limits[0] != lowest or len(limits) == 1:
            limits.insert(0, lowest)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "breaks": [limits]})

    return solve


def natural_breaks(df: DataFrame, value: str, group: list[str], k: int = 5, digits: int = DIGITS) -> DataFrame:
    """Class limits per group: ``group..., breaks ARRAY<DOUBLE>``, lowest value first.

    Values that agree in ``digits`` significant digits are pooled in Spark over all rows, with
    their mean, count and maximum, and the classes of the pools have the least squared
    deviation. The rule is the same at every size; there are at most ``9 * 10 ** (digits - 1)`` pools per
    decade and sign. A class that holds the lowest value alone is merged into the next one; a group of
    one value has it as both limits.
    """
    values = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.when(F.col("v") != 0, F.col("v"))))) - (digits - 1))
    pool = F.coalesce(F.round(F.col("v") / unit), F.lit(0.0))
    pools = values.groupBy(*group, pool.alias("_pool"), unit.alias("_unit")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.max("v").alias("top"), F.min("v").alias("least")
    )
    lowest = pools.groupBy(*group).agg(F.min("least").alias("_low"))
    bins = pools.join(lowest, group)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*group).schema)
    return bins.groupBy(*group).applyInPandas(_solver(group, k), f"{schema}, breaks array<double>")


def assign_class(df: DataFrame, breaks: DataFrame, value: str, group: list[str], salt_on: list[str]) -> DataFrame:
    """Class number from 0: intervals ``(lo, hi]``, the lowest one closed; null outside."""
    joined = salted_join(df, breaks, group, salt_on)
    v = F.col(value).cast("double")
    below = F.size(F.filter("breaks", lambda b: b < v))
    return joined.withColumn(
        "class_no",
        F.when((v >= F.element_at("breaks", 1)) & (v <= F.element_at("breaks", -1)), F.greatest(below - 1, F.lit(0))),
    ).drop("breaks")
