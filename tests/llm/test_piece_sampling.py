import math
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lanewise.llm.piece_sampling import SHARPNESS, Lattices, Vocabulary, _beside, _log_inclusion, decode_flat, decode_pieces, sample_batch, sample_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def held():
    return Lattices(PATH, SHARPNESS)


def segmentations(voc: Vocabulary, text: str):
    """All segmentations (ids) of a short text with their probabilities."""
    s = " " + text

    def cuts(i):
        if i == len(s):
            yield (), 0.0
            return
        steps = [((voc.pieces[s[i:j]],), j, voc.weights[voc.pieces[s[i:j]]]) for j in range(i + 1, len(s) + 1) if s[i:j] in voc.pieces]
        if s[i] not in voc.pieces:
            raw = s[i].encode()
            steps.append((tuple(voc.byte_ids[b] for b in raw), i + 1, voc.byte_weight * len(raw)))
        for ids, j, w in steps:
            for rest, more in cuts(j):
                yield ids + rest, w + more

    found = {ids: math.exp(w) for ids, w in cuts(0)}
    total = sum(found.values())
    return {ids: w / total for ids, w in found.items()}


def test_probabilities(held):
    for text in ("the cat", "  a\tb ", "x①y", "a"):
        want = segmentations(held.vocabulary, text)
        rows = sample_batch(held, [5], [text], 10_000)[0]
        assert {tuple(r[0].tolist()) for r in rows} == set(want)
        for ids, log_prob, _, log_in in rows:
            assert math.exp(log_prob) == pytest.approx(want[tuple(ids.tolist())], rel=1e-9)
            assert log_in == 0.0
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)


def test_draws_without_replacement(held):
    text, n = "in a", 30_000
    want = segmentations(held.vocabulary, text)
    top = dict(sorted(want.items(), key=lambda x: -x[1])[:6])
    found = sample_batch(held, [random.Random(i).getrandbits(64) for i in range(n)], [text] * n, 2)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    pairs = Counter((tuple(f[0][0].tolist()), tuple(f[1][0].tolist())) for f in found)
    for a, pa_ in top.items():
        assert first[a] / n == pytest.approx(pa_, abs=4 * math.sqrt(pa_ / n) + 1e-3)
        assert pairs[a, a] == 0
        for b, pb in top.items():
            if a != b:
                p = pa_ * pb / (1 - pa_)
                assert pairs[a, b] / n == pytest.approx(p, abs=4 * math.sqrt(p / n) + 1e-3)
    # weights 1 / inclusion score make sums over all segmentations unbiased
    sums = [sum(len(ids) * math.exp(lp - li) for ids, lp, _, li in f) for f in found]
    mean = sum(len(ids) * p for ids, p in want.items())
    assert np.mean(sums) == pytest.approx(mean, abs=5 * np.std(sums) / math.sqrt(n))


def test_log_inclusion():
    for x in (-50.0, -21.0, -19.0, -3.0, 0.0, 3.0, 3.6, 5.0):
        assert _log_inclusion(x) == pytest.approx(math.log(-math.expm1(-math.exp(x))), rel=1e-9, abs=1e-12)
    assert _log_inclusion(-2000.0) == -2000.0 and _log_inclusion(math.inf) == 0.0


def test_batches_do_not_matter(held):
    texts = ["one two three four five", "Straße über  Öl", "", "one two three four five", "z" * 300, "a " * 2000]
    whole = sample_batch(held, list(range(6)), texts, 3)
    fresh = Lattices(PATH, SHARPNESS)
    for i in (5, 2, 0, 4):
        alone = sample_batch(fresh, [i], [texts[i]], 3)[0]
        assert [(r[0].tolist(), r[2]) for r in alone] == [(r[0].tolist(), r[2]) for r in whole[i]]
    assert len({tuple(r[0].tolist()) for r in whole[5]}) == 3
    assert [r[0].tolist() for r in whole[2]] == [[]]


def test_decoding_is_the_librarys(held):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("  a  b ", "a\tb\n", "ﬁ ① 漢字 😀", "plain words here", "x" * 500):
        for ids, *_ in sample_batch(held, [3], [text], 3)[0]:
            assert decode_flat(held.vocabulary, ids, np.array([len(ids)]))[0].decode() == text == model.decode(ids.tolist())


def test_documents(spark, documents):
    rows = sample_pieces(documents, "doc_id", "text", PATH, 2).collect()
    texts = {}
    for d in documents.collect():
        texts.setdefault(d.doc_id, []).append(d.text or "")
    assert sum(r.sample == 1 for r in rows) == documents.count()
    for r in rows:
        assert r.decoded_crc32 in {zlib.crc32(t.encode()) for t in texts[r.doc_id]}
    assert sample_pieces(documents.limit(0), "doc_id", "text", PATH).count() == 0
    back = decode_pieces(spark.createDataFrame(rows), "ids", PATH).collect()
    assert all(r.decoded in texts[r.doc_id] for r in back)


def test_small_siblings_are_not_lost():
    # with sharp weights all but one segmentation together weigh less than rounding
    held = Lattices(PATH, 60.0)
    for text in ("the cat", "of the"):
        voc = held.vocabulary
        rows = sample_batch(held, [5], [text], 10_000)[0]
        plain = Lattices(PATH, SHARPNESS).vocabulary
        assert {tuple(r[0].tolist()) for r in rows} == set(segmentations(plain, text))
        assert min(r[1] for r in rows) < -800
        for ids, log_prob, *_ in rows[:5]:
            best = rows[0][0].tolist()
            weight = lambda x: sum(voc.weight_of[i] for i in x)
            assert log_prob - rows[0][1] == pytest.approx(weight(ids.tolist()) - weight(best), rel=1e-9, abs=1e-9)


def test_units_move_between_the_halves(held, monkeypatch):
    from lanewise.llm import piece_sampling

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("étaoin漢", k=rng.randrange(1, 9))) for _ in range(40)) for _ in range(60)]
    whole = sample_batch(held, list(range(60)), texts, 3)
    monkeypatch.setattr(piece_sampling, "CACHE_UNITS", 120)
    small = Lattices(PATH, SHARPNESS)
    for _ in range(2):
        for i, text in enumerate(texts):
            got = sample_batch(small, [i], [text], 3)[0]
            assert [r[0].tolist() for r in got] == [r[0].tolist() for r in whole[i]]
            assert [r[1:] for r in got] == [pytest.approx(r[1:], rel=1e-9, abs=1e-9) for r in whole[i]]
            assert len(small.first) <= 60 + 40


_WORKER = """
import random, sys
import public_tokenizers
from lanewise.llm import piece_sampling as p
held = p.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
rng = random.Random(1)
most = 0
for n in range(40):
    texts = [" ".join("".join(rng.choices("etaoinshrdlué", k=rng.randrange(3, 12))) for _ in range(300)) for _ in range(400)]
    assert sum(map(len, texts)) < p.SLICE
    p.sample_batch(held, list(range(400)), texts, 2)
    used = sum(int(l.split()[1]) for l in open("/proc/self/smaps_rollup") if l.startswith("Pss_Anon")) // 1024
    most = max(most, used)
print(most, len(held.first) + len(held.old_first))
"""


def test_memory_of_a_worker_is_bounded():
    # 4.8 million words, nearly all of them distinct
    done = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, timeout=600, check=True)
    most, units = map(int, done.stdout.split())
    assert most < 350 and units > 50_000


def test_log_mass_beside_each_edge():
    """Plain sums where all shares keep their digits, sums of logs where one is too small."""
    rng = np.random.default_rng(5)
    degrees = np.array([1, 4, 2, 1, 7, 3])
    first = np.cumsum(degrees) - degrees
    for least in (-30.0, -690.0, -900.0):
        logs = rng.uniform(least, 0, int(degrees.sum()))
        logs[[1, 5]] = least + 0.5, least
        got = _beside(logs, first, degrees)
        for f, d in zip(first, degrees):
            for e in range(f, f + d):
                others = [logs[x] for x in range(f, f + d) if x != e]
                assert got[e] == (pytest.approx(np.logaddexp.reduce(others), rel=1e-13, abs=1e-13) if others else -np.inf)
    assert len(_beside(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
