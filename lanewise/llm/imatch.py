"""I-Match fingerprints over randomised lexicon subsets, in SQL functions only.

The lexicon holds the terms whose inverse document frequency lies in a band, written as bounds on the
share of documents that have the term. By counting, no more than (mean distinct terms of a
document) / ``LOW`` terms can reach the lower bound whatever the number of documents, which bounds
the broadcast lexicon. ``SUBSETS`` random subsets of the lexicon, from half of it to a 512th, are drawn by
digests of the terms; a fingerprint has four hex digits of the MD5 of a document's sorted
distinct terms in each subset, ``----`` where it has none. The likeness of two fingerprints is the
share of agreeing subsets among those in which either has terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LOW, HIGH = 0.002, 0.25
RATES = (2, 8, 32, 128, 512)
EACH = 8
SUBSETS = EACH * len(RATES)
BLANK = "----"
SPAN = 256
GROUP = 4096


def terms(text: Column) -> Column:
    """Distinct runs of letters, marks and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Terms that ``low`` to ``high`` of all rows have, and a bit mask of their subsets."""
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    seen = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = total.first()["n"]
    band = seen.filter((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term")
    member = lambda k: F.conv(F.substring(F.md5(F.concat("term", F.lit(f":{k}")).cast("binary")), 1, 8), 16, 10).cast("long")
    mask = sum(
        (F.when(member(k) % RATES[k // EACH] == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(SUBSETS)),
        F.lit(0).cast("long"),
    )
    return band.select("term", mask.alias("mask"))


def _digits(terms_: Column) -> Column:
    """Four digits of the terms of one subset."""
    whole = F.md5(F.array_join(F.sort_array(terms_), " ").cast("binary"))
    return F.when(F.size(terms_) == 0, F.lit(BLANK)).otherwise(F.substring(whole, 1, 4))


def _labelled(which: int):
    return lambda term: F.struct(F.lit(which).alias("which"), term.alias("term"))


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], lexicon_: DataFrame, keep: list[str]) -> DataFrame:
    """Fingerprints of several text columns of rows that ``keys`` identify.

    ``texts`` maps a text column to its fingerprint's column; ``keep`` lists small columns to pass
    on. A text without lexicon terms gets its own MD5 in place of subsets. If ``rows`` are
    partitioned by ``keys[0]``, no shuffle is added.
    """
    marked = rows.select(
        *keys,
        *keep,
        *[F.md5(F.coalesce(c, F.lit("")).cast("binary")).alias(f"_md5_{i}") for i, c in enumerate(texts)],
        F.concat(
            F.array(F.struct(F.lit(-1).alias("which"), F.lit(None).cast("string").alias("term"))),
            *[F.transform(terms(F.col(c)), _labelled(i)) for i, c in enumerate(texts)],
        ).alias("_all"),
    )
    others = [*keep, *[f"_md5_{i}" for i in range(len(texts))]]
    spread = marked.select(*keys, *others, F.explode("_all").alias("e")).select(*keys, *others, "e.*")
    met = spread.join(F.broadcast(lexicon_), "term", "left").filter("which < 0 or mask is not null")
    # one group per text; the other columns ride on a marker row of their own
    lists = [F.collect_list(F.when(F.getbit("mask", F.lit(k)) == 1, F.col("term"))).alias(f"_s{k}") for k in range(SUBSETS)]
    carried = [F.max(F.when(F.col("which") < 0, F.col(c))).alias(c) for c in others]
    by_text = met.groupBy(*keys, "which").agg(*carried, *lists)
    print_ = F.concat(*[_digits(F.col(f"_s{k}")) for k in range(SUBSETS)])
    prints = by_text.select(*keys, "which", *others, print_.alias("_print"))
    whole = prints.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in others],
        *[F.max(F.when(F.col("which") == i, F.col("_print"))).alias(name) for i, name in enumerate(texts.values())],
    )
    return whole.select(
        *keys, *keep, *[F.coalesce(name, f"_md5_{i}").alias(name) for i, name in enumerate(texts.values())]
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those used by either fingerprint; 1 if equal."""
    at = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    cut = lambda x, i: x.substr(i * 4 + 1, F.lit(4))
    used = F.filter(at, lambda i: (cut(a, i) != BLANK) | (cut(b, i) != BLANK))
    same = F.filter(used, lambda i: cut(a, i) == cut(b, i))
    whole = (F.length(a) == 4 * SUBSETS) & (F.length(b) == 4 * SUBSETS)
    return F.when(a == b, F.lit(1.0)).when(~whole, F.lit(0.0)).otherwise(F.size(same) / F.size(used))


def in_order(rows: DataFrame, id_col: str, tie: Column) -> DataFrame:
    """Adds ``bucket`` (ranges of ``SPAN`` ids, null ids apart) and ``place`` within it, by id, then ``tie``."""
    bucket = F.coalesce(F.floor(F.col(id_col) / SPAN), F.lit(-(1 << 60)))
    placed = rows.withColumn("bucket", bucket).withColumn("_tie", tie)
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first(id_col), "_tie")
    return placed.withColumn("place", F.row_number().over(order)).drop("_tie")


def with_next(placed: DataFrame, column: str, alias: str) -> DataFrame:
    """Adds the ``column`` of the following row, that of the first row after the last one.

    ``placed`` has ``bucket`` and ``place``. Followers are found inside a bucket by a window, over its border by the next
    bucket in use, which in turn is found within groups of buckets, so no window spans the table.
    """
    order = Window.partitionBy("bucket").orderBy("place")
    boxed = placed.withColumn("_next", F.lead(F.struct(F.col(column).alias("v"))).over(order))
    firsts = placed.filter("place = 1").select(F.col("bucket").alias("_to"), F.struct(F.col(column).alias("v")).alias("_first"))
    used = placed.filter("place = 1").select("bucket").withColumn("_group", F.floor(F.col("bucket") / GROUP))
    used = stored(used, "buckets")
    near = used.withColumn("_to", F.lead("bucket").over(Window.partitionBy("_group").orderBy("bucket")))
    heads = used.groupBy("_group").agg(F.min("bucket").alias("head"))
    # one row per SPAN * GROUP ids
    whole = Window.partitionBy(F.lit(0))
    after = F.coalesce(F.lead("head").over(whole.orderBy("_group")), F.min("head").over(whole))
    to = near.join(heads.withColumn("_after", after), "_group").select("bucket", F.coalesce("_to", "_after").alias("_to"))
    border = to.join(firsts, "_to").select("bucket", "_first")
    return (
        boxed.join(border, "bucket", "left")
        .withColumn(alias, F.coalesce("_next", "_first")["v"])
        .drop("_next", "_first")
    )
