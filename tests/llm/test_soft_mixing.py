import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lanewise.llm.queries import TARGETS, domain_labels
from lanewise.llm.soft_mixing import FEATURES, SMOOTH, TRUST, fit_rates, mix, with_posteriors

SF = "/root/testdata/sf0.001"


def buckets(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return [xxhash.xxh64_intdigest(w.encode(), 42) % (1 << 64) for w in words]


def bucket(h):
    return (h - (1 << 64) if h >> 63 else h) % FEATURES


def plain(docs, labelled, targets):
    domains = list(targets)
    named = {}
    for i, d in labelled:
        if i is not None and d in domains:
            named[i] = min(d, named.get(i, d))
    counts, rows = np.zeros((len(domains), FEATURES)), np.zeros(len(domains))
    for i, text in docs:
        if i in named:
            k = domains.index(named[i])
            rows[k] += 1
            for b, n in Counter(map(bucket, buckets(text))).items():
                counts[k, b] += n
    priors = np.log((rows + 1) / (rows.sum() + len(domains)))
    likely = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * FEATURES))
    likely -= likely.mean(axis=0)
    p, n = [], []
    for _, text in docs:
        b = [bucket(h) for h in buckets(text)]
        z = priors + likely[:, b].sum(axis=1) * TRUST / (TRUST + len(b))
        p.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        n.append(len(b))
    return np.array(p), np.array(n, float)


def test_documents_of_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in mix(docs, labelled, "doc_id", "text", TARGETS).collect()}
    given = [(r.doc_id, r.text) for r in docs.collect()]
    p, n = plain(given, [tuple(r) for r in labelled.collect()], TARGETS)
    want = np.array(list(TARGETS.values()))
    wanted = want / want.sum() * n.sum()
    rates = np.array([got[i].rate for i, _ in given])
    for (i, _), q, m in zip(given, p, n):
        assert got[i].tokens == m
        assert got[i].posteriors == pytest.approx(q.tolist(), rel=1e-6, abs=1e-12)
    assert (rates >= 0).all()
    assert np.abs((rates * n) @ p - wanted).max() / n.sum() < 2e-4
    # plain projected gradient without acceleration
    r = np.ones(len(n))
    for _ in range(20_000):
        gap = ((r * n) @ p - wanted) / n.sum()
        r = np.maximum(0, r - p @ gap)
    assert rates == pytest.approx(r, abs=0.02)


def test_rates_are_cut_at_zero(spark):
    rows = [([1.0, 0.0], 100), ([0.0, 1.0], 100), ([0.5, 0.5], 10)]
    members = spark.createDataFrame(rows, "posteriors array<double>, tokens long")
    steps = fit_rates(members, [1.0, 0.0], rounds=60)
    r, y = np.ones(3), np.ones(3)
    p = np.array([x[0] for x in rows])
    for g, beta in steps:
        new = np.maximum(0, y - p @ np.array(g))
        r, y = new, new + beta * (new - r)
    assert r[1] < 1e-3 and r[0] > 1.8
    from lanewise.llm.soft_mixing import rate_of
    from pyspark.sql import functions as F

    assert [x.r for x in members.select(rate_of(F.col("posteriors"), steps)[0].alias("r")).collect()] == pytest.approx(r.tolist())


def test_odd_tables(spark, documents):
    labels = spark.createDataFrame([(3, "clean"), (5, "poor"), (5, "toxic"), (None, "clean"), (6, None), (4, "other")], "doc_id long, domain string")
    rows = mix(documents, labels, "doc_id", "text", TARGETS).collect()
    assert len(rows) == documents.count()
    assert all(r.rate >= 0 and math.isclose(sum(r.posteriors), 1) for r in rows)
    same = [r.rate for r in rows if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    assert mix(documents.limit(0), labels, "doc_id", "text", TARGETS).count() == 0
    even = mix(documents, labels.limit(0), "doc_id", "text", {"a": 1.0, "b": 1.0}).collect()
    assert all(r.posteriors == pytest.approx([0.5, 0.5]) and r.rate == pytest.approx(1) for r in even)


def test_stored_rounds_equal_a_plain_run(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([2.0, 2.0, 2.0], 60)
    n = rng.integers(1, 200, 60)
    members = spark.createDataFrame([(x.tolist(), int(m)) for x, m in zip(p, n)], "posteriors array<double>, tokens long")
    shares = (p * n[:, None]).sum(axis=0) / n.sum()
    # within reach, but only after many rounds, and out of reach
    for factors, met in (([0.5, 1.6, 0.9], True), ([3.0, 0.0, 0.0], False)):
        wanted = shares * np.array(factors)
        steps = fit_rates(members, wanted.tolist(), rounds=400)
        r, y = np.ones(60), np.ones(60)
        for g, beta in steps:
            new = np.maximum(0, y - p @ np.array(g))
            r, y = new, new + beta * (new - r)
        gap = (r * n) @ p / n.sum() - wanted
        assert (np.abs(gap).max() < 1e-4) == met
        gram = (p * n[:, None]).T @ p / n.sum()
        moved = np.abs(r - np.maximum(0, r - p @ np.linalg.solve(gram, gap)))
        assert met or (len(steps) < 400 and (moved * n).sum() / n.sum() < 2e-4)
    with pytest.warns(UserWarning, match="after 9 rounds"):
        fit_rates(members, (shares * np.array([3.0, 0.0, 0.0])).tolist(), rounds=9)


def test_rare_words_tell_domains_apart(spark):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(20_000)]
    rows = []
    for i in range(600):
        words = rng.choice(common, 200).tolist()
        rows.append((i, " ".join(words + (["vile"] * 3 if i % 10 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if i % 10 == 0 else "clean") for i in range(0, 600, 3)] + [(i, "toxic") for i in range(0, 600, 10)], "doc_id long, domain string")
    from lanewise.llm.soft_mixing import resample

    kept = {r.doc_id for r in resample(docs, labels, "doc_id", "text", {"clean": 1.0, "toxic": 0.25}).collect()}
    assert sum(i % 10 != 0 for i in kept) > 0.9 * 540 and sum(i % 10 == 0 for i in kept) < 40


def test_plans_hold_no_tables(spark):
    """As constants the tables were 2.6 MB of every text of the plan; as columns every row would carry them."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    likely = [[0.125 + k] * 4096 for k in range(3)]
    plan = with_posteriors(docs, "text", [-1.0, -1.5, -0.9], likely, "p", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000
    assert " AS _likely_" not in plan
