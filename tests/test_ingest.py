"""Geometry against plain versions."""

import random

import pytest

from planlens.operators import graphs as G
from planlens.operators import ingest as I

POLY = "poly_id bigint, ring array<struct<x:double,y:double>>"


def box(i, x0, y0, x1, y1):
    return (i, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbours_whose_corners_do_not_meet(spark):
    # A long box below three short ones (T-junctions), one that is off by less than the width, one that only meets a corner.
    polys = [box(0, 0.0, 0.0, 9.0, 1.0), box(1, 0.0, 1.0, 2.5, 2.0), box(2, 2.5, 1.0, 6.0, 2.0), box(3, 6.0, 1.0005, 9.0, 2.0), box(4, 9.0, 1.0, 10.0, 2.0), box(5, 20.0, 0.0, 21.0, 1.0)]
    df = spark.createDataFrame(polys, POLY)
    assert pairs(I.adjacency(df, 0.001, 0.1)) == [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (3, 4)]
    assert pairs(I.adjacency(df, 0.001, 2.9)) == [(0, 2), (0, 3)]
    assert I.adjacency(df.limit(0), 0.001, 0.1).isEmpty()


def test_neighbours_in_a_random_tiling(spark):
    r = random.Random(3)
    rows, polys, i = [sorted({0.0, 10.0, *(round(r.uniform(0.5, 9.5), 2) for _ in range(4))}) for _ in range(6)], [], 0
    for y, cuts in enumerate(rows):
        for a, b in zip(cuts, cuts[1:]):
            polys.append((i, a, float(y), b))
            i += 1
    want = []
    for u, a, y, b in polys:
        for v, c, z, d in polys:
            share = 1.0 if y == z and (b == c or d == a) else min(b, d) - max(a, c) if abs(y - z) == 1 else 0.0
            if u < v and share >= 0.05:
                want.append((u, v))
    turned = [(i, [(0.8 * x - 0.6 * t, 0.6 * x + 0.8 * t) for x, t in ((a, y), (b, y), (b, y + 1), (a, y + 1))]) for i, a, y, b in polys]
    assert pairs(I.adjacency(spark.createDataFrame(turned, POLY), 1e-6, 0.05)) == sorted(want)


@pytest.mark.parametrize("width", [1e-3, 1.0, 1e6])
def test_nearest_points(spark, width):
    r = random.Random(4)
    left = [(i, r.choice([r.uniform(0, 1000), 1e7]) if i % 9 else None, r.uniform(0, 1000)) for i in range(60)]
    right = [(i, round(r.uniform(0, 1000)), round(r.uniform(0, 1000))) for i in range(40)] + [(99, None, 1.0)]
    a = spark.createDataFrame(left, "atom_id int, x double, y double")
    b = spark.createDataFrame([(i, None if x is None else float(x), float(y)) for i, x, y in right], "r_id int, x double, y double")
    got = {x.atom_id: x.r_id for x in I.nearest(a, b, width).collect()}
    for i, x, y in left:
        want = None if x is None else min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right if u is not None)[1]
        assert got[i] == want
    assert {x.r_id for x in I.nearest(a, b.limit(0), 1.0).collect()} == {None}


def test_bridges_leave_out_atoms_without_a_place(spark):
    nodes = spark.createDataFrame([(0, 5, 0.0, 0.0), (1, 2, None, None), (2, 3, 4.0, 0.0)], "atom_id int, pop int, x double, y double")
    assert [(a, b) for a, b, _ in G.bridges(nodes, spark.createDataFrame([], "u int, v int"))] == [(0, 2)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, j) for j in range(301, 400)]
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 201), *range(300, 401)]], "atom_id int")
    got = {r.atom_id: r.label for r in G.components(nodes, spark.createDataFrame(edges, "u int, v int")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 300 for i in range(300, 400)) and got[400] == 400


def test_nearest_polygon_against_brute_force(spark):
    import math
    import random

    from planlens.operators import ingest as I

    rng = random.Random(5)
    rings = [(i, [(x, y), (x + rng.uniform(1, 40), y), (x, y + rng.uniform(1, 9))]) for i in range(12) for x, y in [(rng.uniform(-100, 100), rng.uniform(-100, 100))]]
    points = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(150)] + [(900, None, 1.0)]

    def far(p, ring):
        best = math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((p[1] - ax) * dx + (p[2] - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, (p[1] - ax - t * dx) ** 2 + (p[2] - ay - t * dy) ** 2)
        return best

    polys = spark.createDataFrame(rings, "poly_id bigint, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame(points, "id bigint, x double, y double")
    want = {p[0]: min(rings, key=lambda r: (far(p, r[1]), r[0]))[0] for p in points[:-1]} | {900: None}
    assert {r.id: r.poly_id for r in I.nearest_polygon(pts, polys, 5.0).collect()} == want
    assert {r.poly_id for r in I.nearest_polygon(pts, polys.limit(0), 5.0).collect()} == {None}
