"""Text and rounding expressions whose built-in namesakes differ from what is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pg_initcap(col: Column) -> Column:
    """Capitalise each run of letters and digits, whatever separates the runs.

    Spark's ``initcap`` starts a word after a blank only.
    """
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    words = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r))))
    return F.array_join(words, "")


def to_int_rounded(col: Column) -> Column:
    """Nearest integer, halves to even; a bare cast would truncate.

    Rounds to 4 digits first so that the order in which a sum was added cannot tip a half.
    """
    return F.bround(F.round(col, 4), 0).cast("bigint")
