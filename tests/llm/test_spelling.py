import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lanewise.llm.queries import op13_spelling_variants
from lanewise.llm.spelling import cells_of, forms, runs_of, variants, vocabulary, with_roots


def plain_vocabulary(rows, length=5, count=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def edited(word):
    """All texts that lack one letter of a word, with the place."""
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]


def plain_near(words):
    """Near words by deletions: a plain method that shares nothing with the index."""
    less = {}
    for w in words:
        for i, cut in edited(w):
            less.setdefault((i, cut), set()).add(w)
    near = {w: set() for w in words}
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for _, cut in edited(w):
            if cut in near:
                near[w].add(cut)
                near[cut].add(w)
    return near


def plain(words):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.mark.parametrize("cell,block", [(2048, 1 << 15), (40, 600), (3, 50)])
def test_random_words(spark, cell, block):
    rng = random.Random(7)
    words = {}
    for _ in range(3000):
        # few letters, so that there are many neighbours and large cells
        word = "".join(rng.choices("abé" if rng.random() < 0.7 else "abcdefgÿ", k=rng.randrange(5, 10)))
        words[word] = rng.randrange(3, 60) if rng.random() < 0.8 else 3
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(with_roots(forms(table, cell, block))) == plain(words)


def test_hot_cell(spark):
    # a third of all words share all but their last letters, others all but their first
    words = {"commonstart" + a + b: 3 + (ord(a) * ord(b)) % 50 for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstu"}
    words |= {a + b + "commonending": 3 + (ord(a) + ord(b)) % 40 for a in "abcdefghijklmnopqrst" for b in "abcdefgh"}
    words |= {"commonstart" + a: 500 for a in "abc"} | {"commonstart": 2000}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert cells_of(table, 50).groupBy("key").count().agg({"count": "max"}).first()[0] <= 20 * 21 + 20 + 4
    assert got(with_roots(forms(table, 50))) == plain(words)


def test_each_pair_meets_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa", "aabaa"]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    near = {r.word: r.n_near for r in forms(table).collect()}
    assert near == {w: len(x) for w, x in plain_near(words).items()}


def test_roots_of_long_chains(spark):
    chain = [("w%03d" % i, "w%03d" % (i + 1) if i < 40 else None) for i in range(41)]
    rows = with_roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.root for r in rows} == {"w040"} and len(rows) == 41


def test_runs(spark):
    assert runs_of(None, 1) == [] and runs_of("", 1) == []
    rows = [(i, f"Straße ÀÉ×÷ ÿ x{i}y don't Word{i}word {'ab' * i}") for i in range(400)] + [(None, "word word words"), (5, "漢字abcdeé́f")]
    want = Counter()
    for doc_id, text in rows:
        want += Counter({w.encode(): n for w, n in plain_vocabulary([(doc_id, text)], 0, 1).items()})
    found = Counter()
    for doc_id, text in rows:
        found.update(runs_of(text, doc_id))
    assert found == want
    assert sum(zlib.crc32(f"{i}:abab".encode()) % 97 == 0 for i in range(400)) >= 1


def test_documents(spark, documents):
    clashing = documents.withColumn("word", documents.text).withColumn("n", documents.n_chars)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(variants(clashing, "doc_id", "text")) == plain(plain_vocabulary(rows))
    again = [(i % 3, " ".join(rows[-1][1:]) + " spelling speling spellling " * 9) for i in range(6)] + [(7, "spelling " * 90), (8, "y" * 4000 + " "), (8, "y" * 4000), (8, "y" * 4000)]
    frame = spark.createDataFrame(again, "doc_id long, text string")
    assert got(variants(frame, "doc_id", "text")) == plain(plain_vocabulary(again))
    assert variants(documents.limit(0), "doc_id", "text").count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = plain_vocabulary([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.word: r.n for r in vocabulary(docs, "doc_id", "text").collect()} == words
    result = op13_spelling_variants(spark, "/root/testdata/sf0.01")
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(words)
    assert got(result) == want
    assert sum(r[1] is not None for r in want) > 20 and np.mean([r[4] for r in want]) > 0.1
