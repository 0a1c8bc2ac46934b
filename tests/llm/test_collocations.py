import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lanewise.llm.collocations import Level, _compact, _ends, _level, _vocabulary, _words, advanced, collocations, double_array, encoded, phrases
from lanewise.llm.queries import op12_collocations


def plain_counts(rows, words=5):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            said = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(said)
            for k in range(1, words + 1):
                found.update((lang, tuple(said[i : i + k])) for i in range(len(said) - k + 1))
    return found, totals


def inside(short, long):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def plain(rows, words=5, least=100, share=100, top=2000):
    found, totals = plain_counts(rows, words)
    known = {key: f for key, f in found.items() if f >= least and len(key[1]) > 1}
    out = {}
    for (lang, phrase), a in known.items():
        if any(o == lang and len(p) > len(phrase) and inside(phrase, p) and 100 * f >= share * a for (o, p), f in known.items()):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = found[lang, phrase[:k]], found[lang, phrase[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return {
        (lang, i, p.decode(), -a, left, right, totals[lang], -score)
        for lang, each in out.items()
        for i, (score, a, p, left, right) in enumerate(sorted(each)[:top], 1)
    }


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "é", "a\x0bb", "x", "y　z", "state", "w\xa0v"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            pick = rng.random()
            if pick < 0.3:
                parts.append("New York state  of mind"[: rng.choice([8, 14, 99])])
            elif pick < 0.35:
                parts.append(f"rare{rng.randrange(10**6)}")
            else:
                parts.append(rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", " ", "\t", ". ", "\n", ",", " ?! "]))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " \t "), ("en", "..."), ("fr", "New York " * 400), ("de", "ha " * 300)]


@pytest.mark.parametrize("shard,share,top", [(1 << 20, 100, 2000), (3, 80, 4)])
def test_equals_brute_force(spark, monkeypatch, shard, share, top):
    rows = rows_of(3, 700)
    frame = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "lang string, text string, n long, phrase string").repartition(5)
    got = collocations(frame, "text", "lang", least=15, share=share, top=top, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(map(tuple, got.collect())) == plain(rows, least=15, share=share, top=top)
    if top == 4:
        everything = collocations(frame, "text", "lang", least=15, share=share, top=None)
        assert set(map(tuple, everything.collect())) == plain(rows, least=15, share=share, top=10**9)


def test_tries_count_every_phrase(spark):
    rows = rows_of(4, 300)
    found, totals = phrases(spark.createDataFrame(rows, "lang string, text string").na.fill("und", ["lang"]), 4, 5, 7)
    counts, n = plain_counts(rows, 4)
    assert {(r.lang, tuple(r.phrase)): r.f for r in found.collect()} == {k: f for k, f in counts.items() if f >= 5}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    from lanewise.llm.collocations import _scored

    a, n = 3 * 10**9 + 7, 8 * 10**12 + 1
    known = spark.createDataFrame([("x", ["p"], a + 5), ("x", ["q"], a + 11), ("x", ["p", "q"], a)], "lang string, phrase array<string>, f long")
    totals = spark.range(1).select(F.lit("x").alias("lang"), F.lit(n).alias("n"))
    assert _scored(known, totals).first().score == 1000 * a * n // ((a + 5) * (a + 11))


def test_double_array():
    rng = np.random.default_rng(2)
    for size, labels in ((0, 5), (1, 5), (400, 30), (5000, 300), (3000, 100_000)):
        edges = np.unique(np.stack([rng.zipf(1.3, size) % 500, rng.integers(1, labels, size)], axis=1), axis=0)
        base, check = double_array(edges[:, 0], edges[:, 1], 501)
        assert (check[base[edges[:, 0]] + edges[:, 1]] == edges[:, 0]).all()
        assert (check >= 0).sum() == len(edges)


def test_level_steps(tmp_path):
    edges = np.array([(0, 3), (0, 9), (4, 3), (7, 1)])
    base, check = double_array(edges[:, 0], edges[:, 1], 8)
    base.tofile(tmp_path / "0.base")
    check.tofile(tmp_path / "0.check")
    level = Level(f"file:{tmp_path}", [0, len(check)])
    states, words = np.meshgrid(np.arange(-1, 12), np.arange(0, 15), indexing="ij")
    got = level.step(states.ravel(), words.ravel())
    hits = {(int(s), int(w)) for s, w, t in zip(states.ravel(), words.ravel(), got) if t >= 0}
    assert hits == set(map(tuple, edges.tolist()))
    assert len(advanced(np.array([7, 1, 0], np.int64), [level])) == 2


def test_levels_of_scattered_children_are_small(spark):
    rng = np.random.default_rng(5)
    sizes = np.concatenate([np.full(40, 500), np.full(300, 20), np.ones(2000, int)])
    pairs = np.unique([(s, w) for s, n in enumerate(sizes.tolist()) for w in rng.integers(1, 100_000, n).tolist()], axis=0)
    level, placed = _level(spark.createDataFrame(pairs.tolist(), "state long, word long"), 1 << 20)
    assert level.starts[-1] < 4 * len(pairs) + 100_000
    to = {(r.state, r.word): r.to for r in placed.collect()}
    assert len(set(to.values())) == len(to) == len(pairs)
    asked = np.concatenate([pairs, np.stack([rng.integers(-1, 2500, 50_000), rng.integers(0, 100_000, 50_000)], axis=1)])
    assert level.step(asked[:, 0], asked[:, 1]).tolist() == [to.get((s, w), -1) for s, w in asked.tolist()]


def test_encoded_rows_are_short(spark):
    words = spark.createDataFrame([("en", "a", 9), ("en", "b", 9)], "lang string, word string, n long")
    rows = encoded(spark.createDataFrame([("en", "a b. c " * 900)] * 3 + [("en", "b a " * 300)], "lang string, text string").coalesce(1), _vocabulary(words, 100)[0]).collect()
    ids = [np.frombuffer(r.ids, "<i4") for r in rows]
    assert all(i[-1] == 0 for i in ids) and sorted(map(len, ids))[-2] <= 130 and 601 <= max(map(len, ids)) < 601 + 128
    assert sum(len(i) for i in ids) == 3 * 900 * 3 + 601


def test_ends():
    ids = np.array([1, 2, 0, 3, 4, 5, 6, 7, 0, 1, 1, 0])
    assert [_ends(ids, n).tolist() for n in (1, 3, 4, 9, 10, 99)] == [[3, 9, 12], [3, 9, 12], [9, 12], [9, 12], [12], [12]]
    assert _ends(ids[:0], 4).tolist() == []


def test_words_and_runs():
    words, codes, counts = _words(pa.array(["A b.c", None, " ..\t ", "a\x0bB\tA"]))
    assert [words[i].as_py() if i >= 0 else "." for i in codes.tolist()] == ["a", "b", ".", "c", ".", "a", ".", "b", "a"]
    assert counts.tolist() == [4, 0, 1, 4]
    ids = np.array([5, 0, 0, 1, 2, 0, 3, 0, 4, 4, 4, 0])
    assert [p.tolist() for p in _compact(ids)] == [[1, 2, 0, 4, 4, 4, 0]]
    assert list(_compact(np.zeros(0, np.int64))) == []


def test_documents(spark, documents):
    rows = [(r.lang, r.text) for r in documents.collect()]
    got = collocations(documents, "text", "lang", least=2)
    assert set(map(tuple, got.collect())) == plain(rows, least=2)
    assert collocations(documents.limit(0), "text", "lang").count() == 0
    assert collocations(documents, "text", "lang", least=10**6).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text")
    want = plain(list(map(tuple, docs.collect())))
    assert set(map(tuple, op12_collocations(spark, "/root/testdata/sf0.01").collect())) == want and len(want) > 20
