"""Outlines of polygons that share borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import outlines
from lanewise.sources import tables


def square(x, y, w=1, h=1, s=100.0):
    return [[(x * s, y * s), ((x + w) * s, y * s), ((x + w) * s, (y + h) * s), (x * s, (y + h) * s)]]


def parts(df, keys=("geoid",)):
    """Per key the sorted (area, corners of each ring) of its parts."""
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), []).append((round(r.area, 3), [len(x) for x in r.rings]))
    return {k: sorted(v) for k, v in out.items()}


RING = [*square(0, 0, 3, 3), square(1, 1)[0]]
GONE = {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} - {(2, 2)} | {(5, 5), (6, 6)}
CASES = {
    # a wide square over two narrow ones: the lower border is cut at the vertex between them
    "partly": ([square(0, 0), square(1, 0), square(0, 1, 2), square(7, 7)], [(10_000.0, [4]), (40_000.0, [4])]),
    "beside": ([square(2, 0)], [(10_000.0, [4])]),
    "repeats": ([square(0, 0), [square(1, 0)[0][::-1]], square(1, 0)], [(20_000.0, [4])]),
    # a hole with an island, two holes that meet in a corner, a far square at a corner
    "board": (
        [*[square(x, y) for x in range(9) for y in range(9) if (x, y) not in GONE], square(9, 9)],
        [(10_000.0, [4]), (10_000.0, [4]), (700_000.0, [4, 4, 4, 4])],
    ),
    # the hole at (1, 1) meets the notch at (0, 0) in one point
    "notch": ([square(x, y) for x in range(4) for y in range(4) if (x, y) not in {(0, 0), (1, 1)}], [(140_000.0, [6, 4])]),
    "given hole": ([RING], [(80_000.0, [4, 4])]),
    "filled hole": ([RING, square(1, 1)], [(90_000.0, [4])]),
    "flat": ([[[(0, 0), (100, 0), (200, 0)]]], None),
}
N, COS, SIN = 14, math.cos(0.37), math.sin(0.37)


def noisy_board(rng):
    """Random cells of a turned board, every vertex off by some nanometres."""
    kept = {(x, y) for x in range(N) for y in range(N) if rng.random() < 0.62}

    def turned(x, y):
        px, py = 90.0 * x, 90.0 * y
        return (COS * px - SIN * py + rng.uniform(-3e-9, 3e-9) + 4e5, SIN * px + COS * py + rng.uniform(-3e-9, 3e-9) + 4e6)

    return kept, [[[turned(x, y), turned(x + 1, y), turned(x + 1, y + 1), turned(x, y + 1)]] for x, y in sorted(kept)]


@pytest.fixture(scope="module")
def dissolved(make_polygons):
    """All cases at once, each as a key of its own: the expected numbers, the noisy board's cells and the outlines."""
    kept, noisy = noisy_board(random.Random(8))
    rows = [(k, polygon) for k, (polygons, _) in CASES.items() for polygon in polygons] + [("noisy", p) for p in noisy]
    found = outlines.dissolve_polygons(make_polygons(rows), ["study_id", "geoid"]).cache()
    yield kept, found
    found.unpersist()


def test_cases(dissolved):
    got = parts(dissolved[1].filter("geoid <> 'noisy'"))
    assert got == {(k,): v for k, (_, v) in CASES.items() if v}


def test_outer_rings_left_holes_right(dissolved):
    def area(ring):
        return sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1])) / 2

    for r in dissolved[1].filter("geoid <> 'noisy'").collect():
        assert area(r.rings[0]) > 0 and all(area(h) < 0 for h in r.rings[1:])
        assert sum(map(area, r.rings)) == pytest.approx(r.area)


def test_rounding_noise(dissolved):
    """Area, number of parts and of corners follow from the cells."""
    kept, got = dissolved[0], dissolved[1].filter("geoid = 'noisy'").collect()
    assert sum(r.area for r in got) == pytest.approx(len(kept) * 8100.0, abs=1e-3)
    groups, left = 0, set(kept)
    while left:
        groups, todo = groups + 1, [left.pop()]
        while todo:
            x, y = todo.pop()
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
    assert len(got) == groups
    corners = 0
    for x in range(N + 1):
        for y in range(N + 1):
            around = [(x - 1, y - 1) in kept, (x, y - 1) in kept, (x, y) in kept, (x - 1, y) in kept]
            corners += 1 if sum(around) in (1, 3) else 2 if around in ([True, False] * 2, [False, True] * 2) else 0
    assert sum(len(ring) for r in got for ring in r.rings) == corners


def test_clipped_outlines_are_whole(make_polygons):
    """Many grid pieces give one outline; a concave area gives two."""
    area = [[(0, 0), (3000, 0), (3000, 900), (1500, 900), (1500, 1700), (3000, 1700), (3000, 2600), (0, 2600)]]
    groups = make_polygons([("w", square(2, 1, 10, 23)), ("e", square(20, 1, 30, 30)), ("tri", [[(100, 150), (1400, 431), (533, 2500)]])])
    got = parts(outlines.clipped_outlines(groups, make_polygons([("x", area)]).drop("geoid"), "geoid", 370.0))
    tri = abs(1300 * 2350 - 433 * 281) / 2
    assert got == {
        ("w",): [(2_300_000.0, [4])],
        ("e",): [(800_000.0, [4]), (900_000.0, [4])],
        ("tri",): [(round(tri, 3), [3])],
    }


def test_boundary_of_named_areas(make_polygons):
    rows = make_polygons([("a", square(0, 0)), ("b", square(1, 0)), ("c", square(2, 0))], key="name")
    got = tables.dissolved_boundary(rows, F.col("name") != "c", 5)
    assert parts(got, ("study_id",)) == {(5,): [(20_000.0, [4])]}


def test_empty(make_polygons):
    assert outlines.dissolve_polygons(make_polygons([]), ["geoid"]).isEmpty()
