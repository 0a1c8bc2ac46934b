"""Mixing by soft membership: document rates whose expected domain totals match targets.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a labelled table, gives every
document posterior probabilities of the domains. A document's tokens count toward the domains in
these shares. Rates, not negative and one at the start, are then fitted by accelerated
projected-gradient least squares: a round sums the rated tokens per domain over all documents (a few
numbers reach the driver), and every rate moves along its document's posteriors and is cut at
zero. A rate is a function of the gradients since it was last stored, so rounds only read stored rows and
nothing is kept between them but one row of numbers each. SQL functions only.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

FEATURES = 1 << 16  # with few buckets the rare words that tell domains apart share theirs with common ones
SAMPLE = 10_000
TRUST = 400.0  # words after which more evidence hardly counts
SMOOTH = 0.5
ROUNDS = 200
TOLERANCE = 1e-4
EVERY = 8  # rounds after which rates are stored


def word_buckets(text: Column, features: int = FEATURES) -> Column:
    """Hash bucket of every word of a text, case kept, since it tells domains apart."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def fit_domains(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domains: list[str], sample: int = SAMPLE, features: int = FEATURES
) -> tuple[list[float], list[list[float]]]:
    """Log priors of the domains and the log-likelihood of each bucket in each domain.

    ``labelled``: ``id_col``, domain. At most ``sample`` of its ids, chosen by a hash, are used, over whole texts; an
    id with several domains counts for the first by name; domains that aren't listed, and nulls, are ignored.
    """
    named = labelled.filter(F.col(id_col).isNotNull() & F.col("domain").isin(*domains))
    known = named.groupBy(id_col).agg(F.min("domain").alias("_domain")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = known.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample)
    met = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)
    # at most features * domains rows
    seen = (
        met.select("_domain", F.explode(F.concat(F.array(F.lit(-1)), word_buckets(F.col("_text"), features))).alias("b"))
        .groupBy("_domain", "b")
        .count()
        .collect()
    )
    counts = np.zeros((len(domains), features))
    rows = np.zeros(len(domains))
    for r in seen:
        if r["b"] < 0:
            rows[domains.index(r["_domain"])] = r["count"]
        else:
            counts[domains.index(r["_domain"]), r["b"]] = r["count"]
    priors = np.log((rows + 1) / (rows.sum() + len(domains)))
    # relative to their mean over the domains, so that buckets that say nothing weigh nothing
    likely = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * features))
    return priors.tolist(), (likely - likely.mean(axis=0)).tolist()


def _numbers(values) -> Column:
    """A constant array of doubles, folded once by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def with_posteriors(docs: DataFrame, text_col: str, priors: list[float], likely: list[list[float]], out_col: str, size_col: str) -> DataFrame:
    """Adds ``out_col`` (array of posteriors) and ``size_col`` (words) to all rows.

    The summed evidence of n words is scaled by ``TRUST / (TRUST + n)``, which keeps long texts' membership
    soft. A text without words has the priors.
    """
    own = {c: _free(docs, c) for c in ("_sums", "_logs", "_scores", "_top", "_exp", "_total")}
    # The tables come by subquery: as constants they would be part of every text of the plan, and the driver keeps those. Each is named
    # once, and so are the words, so the optimizer puts them in their places and no row carries a table.
    names = [_free(docs, f"_likely_{k}") for k in range(len(priors) - 1)]
    tables = docs.sparkSession.createDataFrame([(likely[: len(names)],)], "tables array<array<double>>")
    first = docs.withColumns({name: tables.select(F.col("tables")[k]).scalar() for k, name in enumerate(names)})
    none = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(name) for name in names])

    def add(acc, b):
        return F.struct((acc["n"] + 1).alias("n"), *[(acc[name] + F.col(name)[b]).alias(name) for name in names])

    sums = F.aggregate(word_buckets(F.col(text_col), len(likely[0])), none, add)
    summed = first.withColumn(own["_sums"], sums).drop(*names)
    of = F.col(own["_sums"])
    scale = F.lit(TRUST) / (F.lit(TRUST) + of["n"].cast("double"))
    # the last domain is what the others leave open, since evidence sums to zero over the domains
    logs = [F.lit(priors[k]) + scale * of[name] - F.lit(priors[k]) for k, name in enumerate(names)]
    held = summed.withColumn(own["_logs"], F.array(*logs) if logs else F.expr("cast(array() as array<double>)"))
    rest = F.lit(0.0) - F.aggregate(own["_logs"], F.lit(0.0), lambda acc, x: acc + x)
    scores = F.zip_with(F.concat(own["_logs"], F.array(rest)), _numbers(priors), lambda x, p: x + p)
    held = held.withColumn(own["_scores"], scores).withColumn(own["_top"], F.array_max(own["_scores"]))
    held = held.withColumn(own["_exp"], F.transform(own["_scores"], lambda x: F.exp(x - F.col(own["_top"]))))
    total = F.aggregate(own["_exp"], F.lit(0.0), lambda acc, x: acc + x)
    return (
        held.withColumn(size_col, of["n"].cast("long"))
        .withColumn(own["_total"], total)
        .withColumn(out_col, F.transform(own["_exp"], lambda x: x / F.col(own["_total"])))
        .drop(*own.values())
    )


def rate_of(posteriors: Column, steps: list[tuple[list[float], float]], start: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Rate and extrapolated rate after the given rounds (scaled gradient, momentum) from ``start``, one by default."""
    r, y = start or (F.lit(1.0), F.lit(1.0))
    if not steps:
        return r, y
    start = F.struct(r.alias("r"), y.alias("y"))
    rounds = F.transform(
        F.split(F.lit(";".join(",".join(repr(float(v)) for v in [beta, *g]) for g, beta in steps)), ";"),
        lambda s: F.split(s, ",").cast("array<double>"),
    )

    def move(acc, step):
        slope = F.aggregate(
            F.zip_with(posteriors, F.slice(step, 2, len(steps[0][0])), lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x
        )
        r = F.greatest(F.lit(0.0), acc["y"] - slope)
        return F.struct(r.alias("r"), (r + step[0] * (r - acc["r"])).alias("y"))

    state = F.aggregate(rounds, start, move)
    return state["r"], state["y"]


def domain_shares(members: DataFrame, k: int) -> list[float]:
    """Expected share of each domain in all tokens of ``members`` (posteriors, tokens); zeros without tokens."""
    tokens = F.col("tokens").cast("double")
    found = members.agg(F.sum(tokens).alias("all"), *[F.sum(tokens * F.col("posteriors")[i]).alias(f"s{i}") for i in range(k)]).first()
    return [found[f"s{i}"] / found["all"] if found["all"] else 0.0 for i in range(k)]


def fit_rates(members: DataFrame, wanted: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[list[float], float]]:
    """Rounds of accelerated projected gradient that bring the domains to ``wanted`` shares of all present tokens.

    ``members``: posteriors, tokens (stored). Minimises half the squared gap between rated and wanted totals, weighted by
    the inverse of the domains' Gram matrix, under which a full step is safe and few rounds are needed. Steps are
    scaled by a document's tokens, and momentum starts anew whenever the weighted gap has grown. The rounds end when every gap is below
    ``tolerance`` of all tokens, or when shares that can't be met are as near as least squares bring them (a step would move less than
    ``tolerance`` of all tokens); a warning tells of rounds that ran out before. A sum over one asks for more tokens
    than there are, which takes rates above one.
    """
    k = len(wanted)
    wanted = np.array(wanted, float)
    p = lambda i: F.col("posteriors")[i]
    tokens = F.col("tokens").cast("double")
    gram = members.agg(
        F.sum(tokens).alias("all"), *[F.sum(tokens * p(i) * p(j)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    ).first()
    whole = gram["all"]
    if not whole:
        return []
    matrix = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / whole
    # a floor on the eigenvalues keeps domains that no document tells apart from exploding
    inverse = np.linalg.inv(matrix + 1e-6 * np.trace(matrix) * np.eye(k))
    steps: list[tuple[list[float], float]] = []
    fresh = 0
    held = members.select("tokens", "posteriors", F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    momentum, before = 1.0, math.inf
    for _ in range(rounds):
        r, y = rate_of(F.col("posteriors"), steps[fresh:], (F.col("r"), F.col("y")))
        state = held.select("tokens", "posteriors", r.alias("r"), y.alias("y"))
        sums = state.agg(*[F.sum(tokens * F.col(c) * p(i)).alias(f"{c}{i}") for c in ("r", "y") for i in range(k)]).first()
        gap = np.array([sums[f"r{i}"] for i in range(k)]) / whole - wanted
        if np.abs(gap).max() < tolerance:
            return steps
        if len(steps) - fresh == EVERY:
            held, fresh = stored(state, "rates"), len(steps)
            if _movement(held, (inverse @ gap).tolist()) < tolerance * whole:
                return steps
        slope = np.array([sums[f"y{i}"] for i in range(k)]) / whole - wanted
        weighted = float(gap @ inverse @ gap)
        momentum = 1.0 if weighted > before else momentum
        before = weighted
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        steps.append(((inverse @ slope).tolist(), (momentum - 1) / after))
        momentum = after
    warnings.warn(f"after {rounds} rounds the domains are up to {np.abs(gap).max():.2g} of all tokens from their targets", stacklevel=2)
    return steps


def _movement(state: DataFrame, slope: list[float]) -> float:
    """Tokens that a step along ``slope`` moves: zero where no step brings the domains nearer."""
    along = sum((F.lit(g) * F.col("posteriors")[i] for i, g in enumerate(slope)), F.lit(0.0))
    moved = F.abs(F.col("r") - F.greatest(F.lit(0.0), F.col("r") - along))
    return state.agg(F.sum(F.col("tokens") * moved).alias("all")).first()["all"]


def mix(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, targets: dict[str, float], sample: int = SAMPLE
) -> DataFrame:
    """Rates for documents: ``id_col``, text_hash, tokens, posteriors (in the order of ``targets``), rate.

    ``targets``: wanted weight of each domain in all tokens. One row per row of ``docs``.

    Defined cases: null and blank texts have no tokens and the priors as posteriors; a null id gets a rate like any
    other; repeated rows get equal rates; without labels the posteriors are even and all rates are what the
    targets' sum of one asks, one; an empty table gives no rows; other columns are not read.
    """
    domains = list(targets)
    rows = docs.select(F.col(id_col), F.col(text_col))
    priors, likely = fit_domains(rows, labelled, id_col, text_col, domains, sample)
    members = stored(
        with_posteriors(rows, text_col, priors, likely, "posteriors", "tokens").select(
            id_col, F.xxhash64(text_col).alias("text_hash"), "tokens", "posteriors"
        ),
        "members",
    )
    total = sum(targets.values())
    steps = fit_rates(members.select("tokens", "posteriors"), [targets[d] / total for d in domains])
    return members.withColumn("rate", rate_of(F.col("posteriors"), steps)[0])


def resample(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, factors: dict[str, float], sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with every row kept, dropped or repeated by its rate.

    ``factors``: wanted expected tokens per domain, as a multiple of the present ones. A row with rate r comes
    floor(r + u) times, where u in [0, 1) is a hash of its id and text. Cases are as in :func:`mix`.
    """
    domains = list(factors)
    rows = docs.select(F.col(id_col), F.col(text_col))
    priors, likely = fit_domains(rows, labelled, id_col, text_col, domains, sample)
    members = stored(
        with_posteriors(rows, text_col, priors, likely, "posteriors", "tokens").select("tokens", "posteriors"), "members"
    )
    shares = domain_shares(members, len(domains))
    steps = fit_rates(members, [factors[d] * s for d, s in zip(domains, shares)])
    posteriors, tokens, copies = (_free(docs, c) for c in ("posteriors", "tokens", "copies"))
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 20)) / float(1 << 20)
    rated = with_posteriors(docs, text_col, priors, likely, posteriors, tokens)
    times = F.floor(rate_of(F.col(posteriors), steps)[0] + u).cast("int")
    # array_repeat of nothing drops the row
    return rated.withColumn(copies, F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"{name}_"
    return name
