import math
import random

import numpy as np
import pytest

from lanewise.llm.bitsliced import add_slices, slice_block, top_inner_products, top_rows

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank string"


def plain(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and ok(v)]
    asked = [(i, v) for i, v in used if i in queries]
    out = []
    for q, a in asked:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in used if i != q and len(a) == len(b))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_slices_add_exactly():
    rng = np.random.default_rng(1)
    for n, dim in ((1, 3), (64, 1), (200, 5), (130, 0)):
        values = rng.integers(-300, 300, (n, dim))
        query = rng.integers(-300, 300, dim)
        sums, base = add_slices(query, *slice_block(values))
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) for s in sums]
        got = base + sum((b << w for w, b in enumerate(bits)), np.zeros(n, np.int64))
        assert got.tolist() == (values @ query).tolist()
        allowed = np.packbits(np.pad(np.ones(n, np.uint8), (0, -n % 64)), bitorder="little").view(np.uint64)
        for k in (1, 5, n, n + 3):
            want = sorted(range(n), key=lambda i: (-got[i], i))[:k]
            assert sorted(top_rows(sums, allowed, k).tolist()) == sorted(want)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], 0, "x", "y") for i in range(150)]
    rows += [(150 + i, [0.1] * 6, 0, "x", "y") for i in range(30)]  # ties
    rows += [(200, None, 0, None, None), (250, [0.1, None], 0, None, None), (300, [math.nan] * 6, 0, None, None),
             (301, [math.inf] * 6, 0, None, None), (None, [1.0] * 6, 0, None, None), (350, [0.5, 0.5], 0, None, None),
             (351, [0.25, -1.0], 0, None, None), (400, [], 0, None, None), (401, [], 0, None, None), (450, [9.0, 1.0, 2.0], 0, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = top_inner_products(frame, frame.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, block, 3)
    want = plain(rows, {i for i in range(0, 1000, 50)}, 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    empty = frame.limit(0)
    assert top_inner_products(empty, empty, "vec_id", "embedding").count() == 0


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice((-1, 1)) * 10.0 ** rng.uniform(4, 6.5) for _ in range(3)], 0, "x", "y") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = top_inner_products(frame, frame.filter("vec_id % 10 = 0"), "vec_id", "embedding", 4, 25, 3)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, set(range(0, 60, 10)), 4)
    values = np.array([[-(1 << 62) - 5, 7], [1 << 62, -3], [(1 << 63) - 1, 0]])
    lows, widths, slices = slice_block(values)
    assert widths.tolist() == [64, 4] and lows.tolist() == [-(1 << 62) - 5, -3]
    sums, base = add_slices(np.array([-3, 2]), lows, widths, slices)
    got = [base + sum(int(s[0] >> np.uint64(i) & np.uint64(1)) << w for w, s in enumerate(sums)) for i in range(3)]
    assert got == [-3 * a + 2 * b for a, b in values.tolist()]
