import random

import corpus_pipeline
from lanewise.llm.near_copies import BANDS, band_keys, minima, one_of_each_group, shingle_set, similar


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def words_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words):
    """A copy with a tail appended, a passage cut or inserted, or single words changed."""
    n, kind = len(words), rng.randrange(4)
    part = rng.randrange(1, max(2, n // 5))
    at = rng.randrange(n)
    if kind == 0:
        return words + words_of(rng, part)
    if kind == 1:
        return words[:at] + words[at + part :] or words
    if kind == 2:
        return words[:at] + words_of(rng, part) + words[at:]
    return [w if rng.random() > 0.02 else "new" for w in words]


def test_recall_of_candidates():
    rng = random.Random(1)
    hit = total = 0
    for n in (12, 30, 60, 100, 300, 1000):
        for _ in range(150):
            words = words_of(rng, n)
            a, b = " ".join(words), " ".join(edited(rng, words))
            wanted = jaccard(shingles(a), shingles(b)) >= 0.8
            first, second = shingle_set(a), shingle_set(b)
            assert similar(first, second) == wanted
            if wanted:
                total += 1
                hit += bool((band_keys(minima(first)) == band_keys(minima(second))).any())
    print(f"{hit} of {total} pairs meet in one of {BANDS} bands")
    assert total > 300 and hit >= 0.995 * total


def test_groups_equal_exact_similarity(spark, documents):
    rng = random.Random(4)
    texts = []
    for n in [8, 20, 40, 60, 100, 150, 300] * 3:
        words = words_of(rng, n)
        texts += [" ".join(words)] + [" ".join(edited(rng, words)) for _ in range(5)]
    # a dense group, whose members are often below 0.8 of each other, and many just below 0.8 of one text
    words = words_of(rng, 120)
    texts += [" ".join(w if rng.random() > 0.015 else f"x{rng.randrange(99)}" for w in words) for _ in range(60)]
    words = words_of(rng, 100)
    texts += [" ".join(words)] + [" ".join(words + words_of(rng, 26)) for _ in range(20)]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts, 100)]
    frame = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    given = [(r.doc_id, shingles(r.text)) for r in frame.collect()]
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if jaccard(given[i][1], given[j][1]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(given):
        groups.setdefault(find(i), []).append(doc_id)
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    for cell in (8, 256):
        out = one_of_each_group(frame, "doc_id", "text", cell)
        assert out.columns == frame.columns
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want


def below(rng, n=100, at=(20, 45, 70)):
    """Pairs of texts with three scattered words changed: a similarity of 0.73."""
    for _ in range(40):
        words = words_of(rng, n)
        yield " ".join(words), " ".join("new" if i in at else w for i, w in enumerate(words))


def test_texts_below_the_similarity_stay(spark, documents):
    texts = [t for pair in below(random.Random(7)) for t in pair]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, documents.schema)
    assert corpus_pipeline.drop_near_copies(spark, frame, "").count() == len(texts)


def test_rows_out_grow_with_the_rows(spark):
    # two large unlike groups that share bands, and many texts just below the similarity of one text
    from pyspark.sql import functions as F

    from lanewise.llm import near_copies

    rng = random.Random(9)
    counts = {}
    for size in (60, 300):
        words = words_of(rng, 100)
        texts = [" ".join(words[:90] + words_of(rng, 14)) for _ in range(size)]
        classes = [(i, minima(shingle_set(t))) for i, t in enumerate(texts)]
        rows = [(7, 3, i, i, -1, bytes((m & 255).astype("uint8")), band_keys(m).tolist()) for i, m in classes]
        cells = spark.createDataFrame(rows, near_copies._MEMBER)
        paired = near_copies._paired(cells.withColumn("band", F.lit(0)))
        links = near_copies._joined(paired, spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
        counts[size] = paired.count(), links.count()
        assert counts[size][0] <= size and counts[size][1] < size
    assert counts[300][0] > 60


def test_trie_links_are_confirmed(spark, monkeypatch):
    # without any bands the trie still finds the closest copies
    from lanewise.llm import near_copies

    rng = random.Random(2)
    texts = []
    for _ in range(10):
        words = words_of(rng, 400)
        texts += [" ".join(words), " ".join(words[:-1] + ["new"])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "tree", None)
    monkeypatch.setattr(near_copies, "band_keys", lambda least: least[:0].view("int64"))
    kept = {r.doc_id for r in one_of_each_group(frame, "doc_id", "text").collect()}
    assert len(kept) < 15 and all(i in kept or i - 1 in kept for i in range(20))
