"""URL filter: host-suffix and path-prefix expressions matched to rules by hash prefix.

A rule is a host, a path and an action. It fits the URLs of its host and of all subdomains
whose path starts with the rule's path. Rules are keyed by the SHA-256 of the expression
``host/dir/``, where ``dir`` is the rule's path up to its last ``/``. A URL expands into the
expressions that any rule as deep as the deepest given one could have, the two sides meet on the first
eight hex digits, and the full digest and the whole path are compared afterwards. The longest
rule wins. Built of SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder).cast("binary"), 256)


def _depth(path: Column) -> Column:
    """Number of ``/`` in a path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _expressions(host: Column, path: Column, most_labels: int, most_depth: int) -> Column:
    """Digests of each host suffix with each path prefix that ends with ``/`` (or is empty)."""
    labels = F.split(host, r"\.", -1)
    parts = F.slice(F.split(path, "/", most_depth + 1), 1, F.least(_depth(path), F.lit(most_depth)))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda i: F.array_join(F.slice(labels, -i, i), "."),
    )
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(folders, lambda p: _digest(h, p))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow"
) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``.

    ``rules``: host, path, action (``allow`` or ``block``). ``rule`` is the winning rule's host and path
    joined, null where none fits; ``verdict`` is then ``default``. Among fitting rules the longest (host and
    path together) wins, then the longer host, then ``block``.

    Defined cases: a null URL or one without ``://`` has an empty host and path, and fits no
    rule with a host; null ids are kept as they are; repeated rows give repeated rows; rules
    with a null host or action are ignored and a null rule path counts as empty; without
    rules, or pages, the result is all default, or empty. Other columns of ``pages`` are not read.

    The number of expressions of a URL is bounded by the deepest rule, not by the URL. A page
    costs one row in the shuffle, since its expressions are combined before it.
    """
    kept = rules.filter("host is not null and action is not null").select(
        ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action"
    )
    reach = kept.agg(F.max(_labels(F.col("r_host"))).alias("l"), F.max(_depth(F.col("r_path"))).alias("d")).first()
    most_labels, most_depth = reach["l"] or 0, reach["d"] or 0
    keyed = kept.distinct().select(
        "*",
        F.regexp_extract("r_path", r"(?s)^(.*/)?", 0).alias("folder"),
    ).withColumn("full", _digest(F.col("r_host"), F.col("folder")))
    table = keyed.select(
        F.substring("full", 1, SHORT).alias("short"), F.col("full").alias("r_full"), "r_host", "r_path", "action"
    )
    urls = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    none = F.array(F.lit(None).cast("string"))
    asked = F.concat(none, _expressions(F.col("host"), F.col("path"), most_labels, most_depth)) if most_labels else none
    spread = urls.withColumn("full", F.explode(asked)).withColumn("key", F.substring("full", 1, SHORT))
    met = spread.join(table, spread["key"] == table["short"], "left")
    fits = (F.col("full") == F.col("r_full")) & F.startswith(F.col("path"), F.col("r_path"))
    won = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        (F.col("action") == "block").cast("int").alias("strict"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("action").alias("action"),
    )
    judged = met.groupBy("id", "host", "path").agg(
        F.max(F.when(fits, won)).alias("won"), F.sum(F.when(F.col("full").isNull(), 1)).alias("copies")
    )
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
