import random

import numpy as np
import xxhash

from lanewise.llm.simhash_trie import _merged, join_nodes, merge_stars, near_duplicates, simhash, trie_links

M = (1 << 64) - 1


def plain_simhash(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    cut = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(c, 42) for c in cut]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(words, bits):
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = sorted(set(words))
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {frozenset(w for w in words if find(w) == r) for r in {find(w) for w in words}}


def cluster(rng, n):
    """Random words, chains of near words, and a dense ball around one word."""
    words = {rng.getrandbits(64) for _ in range(n)}
    ball = rng.getrandbits(64)
    words |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)}
    x = rng.getrandbits(64)
    for _ in range(60):
        for _ in range(3):
            x ^= 1 << rng.randrange(64)
        words.add(x)
    return sorted(words | {0, M, 1 << 63})


def test_simhash():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " \t".join(rng.choice(["Ab", "c", "É", "dd", "e|"]) for _ in range(n))
        for shingle in (1, 3, 5):
            assert simhash(text, shingle) == plain_simhash(text, shingle)
    assert simhash(None, 3) == simhash(" \n", 3) == 0


def test_pairs_of_two_nodes():
    rng = random.Random(2)
    for bits, size in ((0, 300), (3, 400), (7, 250), (3, 20)):
        words = cluster(rng, size)
        root = join_nodes(np.array(words, np.uint64), None, None, 0, 0, bits, 0)
        found = {}
        for w, r in zip(words, root):
            found.setdefault(r, set()).add(w)
        got = {frozenset(v) for v in found.values()}
        if bits == 0:
            assert got == components(words, 0)
        # one trie alone may miss links, but makes none up
        whole = components(words, bits)
        assert all(any(g <= w for w in whole) for g in got)


def test_local_components():
    assert _merged(np.arange(6), np.array([1, 4, 3]), np.array([2, 5, 2])).tolist() == [0, 1, 1, 1, 4, 4]


def frame_of(spark, words, more=None):
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    rows = [(i, w, None if more is None else more[i]) for i, w in enumerate(signed)]
    return spark.createDataFrame(rows, "node long, word long, more binary")


def classes_of(spark, links, words):
    root = dict(enumerate(range(len(words)))) | {r.node: r.root for r in merge_stars(links).collect()}
    got = {}
    for i, r in root.items():
        got.setdefault(r, set()).add(i)
    return {frozenset(v) for v in got.values()}


def test_links_equal_brute_force(spark):
    words = cluster(random.Random(3), 700)
    place = {w: i for i, w in enumerate(words)}
    for leaf, bits in ((64, 3), (100_000, 3), (300, 7), (64, 1)):
        got = classes_of(spark, trie_links(frame_of(spark, words), bits, leaf), words)
        assert got == {frozenset(place[w] for w in g) for g in components(words, bits)}


def test_links_with_more_bits(spark):
    rng = random.Random(5)
    words = cluster(rng, 150)
    words = sorted(words + words[:100])
    base = [rng.getrandbits(128) for _ in range(3)]
    more = [rng.choice(base) ^ sum(1 << rng.randrange(128) for _ in range(4)) & (1 << 128) - 1 for _ in words]
    packed = [m.to_bytes(16, "little") for m in more]
    got = classes_of(spark, trie_links(frame_of(spark, words, packed), 3, 64, 8), words)
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= 3 and (more[i] ^ more[j]).bit_count() <= 8:
                root[find(i)] = find(j)
    assert got == {frozenset(i for i in range(len(words)) if find(i) == r) for r in map(find, range(len(words)))}


def test_more_rows_in_a_word_than_a_leaf_holds(spark):
    rng = random.Random(6)
    word = rng.getrandbits(64)
    base = [rng.getrandbits(128) for _ in range(4)]
    words, more = [], []
    for i in range(90):
        words.append(word if i % 3 else word ^ 5)
        more.append(base[i % 4] ^ 1 << rng.randrange(128))
    for word_bits, groups in ((3, 4), (0, 8)):
        packed = [m.to_bytes(16, "little") for m in more]
        got = classes_of(spark, trie_links(frame_of(spark, words, packed), word_bits, 16, 4), words)
        want = {}
        for i in range(90):
            want.setdefault((i % 4, word_bits or words[i]), set()).add(i)
        assert len(want) == groups and got == {frozenset(v) for v in want.values()}


def test_documents(spark, documents):
    rows = near_duplicates(documents, "doc_id", "text").collect()
    assert len(rows) == documents.count()
    by = {}
    for d in documents.collect():
        by.setdefault(plain_simhash(d.text, 3), []).append(d.doc_id)
    groups = components(by, 3)
    for r in rows:
        group = next(g for g in groups if int(r.fingerprint, 16) in g)
        ids = [i for w in group for i in by[w] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert near_duplicates(documents.limit(0), "doc_id", "text").count() == 0
