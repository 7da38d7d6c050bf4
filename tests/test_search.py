"""Search and verification against enumeration on small grids."""

from fractions import Fraction

import numpy as np
import pytest

from planlens.model import Instance, Regime
from planlens.operators import cells as C
from planlens.operators import districts as D
from planlens.operators import search as S
from planlens.plans.verify import verify
from planlens.sources import instances

ANY = Regime("D", (0, 1), (1, 5), ("A",), None)


def square(spark, n):
    atom = spark.createDataFrame([(i, f"g{i}", 0, 1, float(i % n), float(i // n)) for i in range(n * n)], "atom_id int, geoid string, county int, pop bigint, x double, y double")
    vote = spark.createDataFrame([(i, "A", 10 + i, 20) for i in range(n * n)], "atom_id int, contest string, d bigint, r bigint")
    edges = [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * n - n)]
    return Instance(atom, vote, spark.createDataFrame(edges, "u int, v int"))


def plan_df(spark, ids, plan, k, name="p"):
    return spark.createDataFrame([(name, k, int(i), int(j)) for i, j in zip(ids, plan)], "plan string, k int, atom_id int, district int")


def test_number_of_partitions_of_a_square(spark):
    g = S.local(square(spark, 5), ANY)
    assert sum(1 for _ in S.plans(g, 5, 5, 5)) == 4006


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_spectrum_and_bounds(spark, seed):
    i = instances.grid(spark, 3, 4, seed, counties=2)
    g = S.local(i, ANY)
    best = S.spectrum(g, 2, ANY)
    found = [x[0] for x in best]
    assert found == sorted(found, reverse=True)
    # Duality: q districts of margin m exist exactly up to the q-th largest margin.
    for q, (m, p) in enumerate(best, 1):
        v = verify(i, plan_df(spark, g.ids, p, 2), Regime("D", (m.numerator, m.denominator), (1, 5), ("A",), None)).first()
        assert v.valid and v.safe >= q
        assert S.decide(g, 2, q, Regime("D", (m.numerator, m.denominator), (1, 5), ("A",), None)) is not None
        more = m + Fraction(1, 10**9)
        assert S.decide(g, 2, q, Regime("D", (more.numerator, more.denominator), (1, 5), ("A",), None)) is None
        lo, hi = S.bisect(g, 2, q, ANY, 200, 101)
        assert (lo < 0 or Fraction(lo, 200) <= m) and m < Fraction(hi, 200)
    # Leaving geography out never excludes what exists.
    grid = spark.createDataFrame([(a, 100) for a in range(-30, 31, 5)], "m_n int, m_d int")
    for r in C.geography_free(i, ("D", "A"), grid, 2, (1, 5)).collect():
        if found[r.q - 1] >= Fraction(r.m_n, r.m_d):
            assert r.possible
    # A split budget can only lessen the margins, and a larger one lessens them less.
    by_cap = [S.spectrum(g, 2, Regime("D", (0, 1), (1, 5), ("A",), c)) for c in (0, 1, 2)]
    for small, large in zip(by_cap, by_cap[1:] + [best]):
        for a, b in zip(small, large):
            assert a is None or a[0] <= b[0]


def test_search_finds_valid_plans_no_better_than_the_best(spark):
    i = instances.grid(spark, 3, 4, 5)
    found = S.search(i, ANY, 2, 1, seeds=3, steps=40).cache()
    assert found.select("plan").distinct().count() == 3
    assert verify(i, found.select("plan", "k", "atom_id", "district"), ANY).where("NOT valid").isEmpty()
    top = S.spectrum(S.local(i, ANY), 2, ANY)[0][0]
    assert all(Fraction(r.n, r.d) <= top for r in found.select("n", "d").distinct().collect())
    assert S.best_of(found).count() == 12


def test_party_swap(spark):
    i = instances.grid(spark, 3, 4, 7)
    g = S.local(i, ANY)
    swapped = Instance(i.atom, D.swapped(i).vote, i.edge)
    r = Regime("R", (0, 1), (1, 5), ("A",), None)
    assert [x[0] for x in S.spectrum(g, 2, ANY)] == [x[0] for x in S.spectrum(S.local(swapped, r), 2, r)]


def test_verify_reports_errors_and_edge_cases(spark):
    i = square(spark, 4)
    zero = Instance(i.atom, i.vote.selectExpr("atom_id", "contest", "CAST(IF(atom_id < 4, 0, d) AS BIGINT) d", "CAST(IF(atom_id < 4, 0, r) AS BIGINT) r"), i.edge)
    rows = np.arange(16) // 4
    apart = np.where(np.isin(np.arange(16), [0, 15]), 0, np.where(np.arange(16) < 8, 1, 2))
    plans = plan_df(spark, range(16), rows, 4, "rows").unionByName(plan_df(spark, range(16), apart, 4, "apart")).unionByName(plan_df(spark, range(15), rows[:15], 4, "short"))
    out = {r.plan: r for r in verify(zero, plans, ANY).collect()}
    assert out["rows"].valid and out["rows"].margins[0] == -0.5 and out["rows"].safe == sum(m >= 0 for m in out["rows"].margins)
    assert any("not connected" in e for e in out["apart"].errors) and any("empty" in e for e in out["apart"].errors)
    assert "wrong length" in out["short"].errors


def test_ward_merges_make_whole_counties(spark):
    i = instances.grid(spark, 4, 4, 3, counties=1)
    m = S.ward_nodes(i).collect()
    assert len(m) == 15 and len({r.new for r in m}) == 15
    kids = [c for r in m for c in (r.a, r.b)]
    assert len(kids) == len(set(kids))


def test_bridges(spark):
    from planlens.operators.graphs import bridges

    nodes = spark.createDataFrame([(0, 5, 0.0, 0.0), (1, 5, 1.0, 0.0), (2, 1, 4.0, 0.0), (3, 2, 0.0, 9.0)], "atom_id int, pop int, x double, y double")
    edges = spark.createDataFrame([(0, 1)], "u int, v int")
    assert [(a, b) for a, b, _ in bridges(nodes, edges)] == [(0, 3), (1, 2)]


def test_neighbourhoods_improve_and_stay_valid(spark):
    i = instances.grid(spark, 3, 4, 5, counties=3)
    g = S.local(i, ANY)
    start = S.random_plan(g, 2, (1, 5), np.random.default_rng(1))
    before = sorted(S.margins(g, start, 2), reverse=True)[0]
    everything, m = S.best_nearby(g, start, 2, 1, ANY, set(range(g.n)))
    assert m == S.spectrum(g, 2, ANY)[0][0]
    found = S.improve(i, ANY, plan_df(spark, g.ids, start, 2), 2, 1, seeds=3).cache()
    assert verify(i, found.select("plan", "k", "atom_id", "district"), ANY).where("NOT valid").isEmpty()
    assert all(before <= Fraction(r.n, r.d) <= m for r in found.collect())
