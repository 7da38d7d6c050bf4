"""Decisions over cells against enumeration on small grids."""

import json
from fractions import Fraction

import numpy as np
import pytest

from planlens.model import Regime
from planlens.operators import brackets as B
from planlens.operators import decide as DC
from planlens.operators import search as S
from planlens.plans.verify import verify
from planlens.sources import instances, runs


@pytest.mark.parametrize("rows, cols, k, counties, seed", [(3, 4, 2, 2, 1), (3, 4, 3, 3, 2), (4, 4, 2, 2, 3), (3, 5, 3, 1, 4), (4, 4, 4, 4, 5)])
@pytest.mark.parametrize("cap", [None, 0, 1])
def test_decisions_agree_with_enumeration(spark, rows, cols, k, counties, seed, cap):
    i = instances.grid(spark, rows, cols, seed, counties=counties)
    base = Regime("D", (0, 1), (1, 4), ("A",), cap)
    g, at = S.local(i, base), DC.places(i)
    best = S.spectrum(g, k, base)
    for q in range(1, k + 1):
        exact = best[q - 1][0] if best[q - 1] is not None else None
        for m in [Fraction(x, 100) for x in (-50, -10, -2, 0, 2, 5, 10, 20)] + ([exact, exact + Fraction(1, 10**6)] if exact is not None else []):
            r = Regime("D", (m.numerator, m.denominator), (1, 4), ("A",), cap)
            got = DC.decide(g, at, k, q, r, 200_000)
            if got.status == "feasible":
                assert DC.checked(g, got.plan, k, q, r) and exact >= m
            elif got.status == "infeasible":
                assert exact is None or exact < m
            assert got.status != "unknown"
            # The pool never excludes what exists.
            if exact is not None and exact >= m:
                assert DC.decide(g, at, k, q, r, 20_000, pool_only=True).status == "unknown"


def test_few_steps_say_unknown_and_never_a_wrong_answer(spark):
    i = instances.grid(spark, 4, 4, 6, counties=2)
    base = Regime("D", (0, 1), (1, 4), ("A",), None)
    g, at = S.local(i, base), DC.places(i)
    best, said = S.spectrum(g, 3, base), set()
    for steps in (1, 5, 20, 80, 300, 5000):
        for x in range(-20, 40, 4):
            got = DC.decide(g, at, 3, 2, Regime("D", (x, 100), (1, 4), ("A",), None), steps)
            said.add(got.status)
            assert got.status == "unknown" or (got.status == "feasible") == (best[1][0] >= Fraction(x, 100))
    assert said == {"unknown", "feasible", "infeasible"}


def test_pinned_atoms_keep_their_districts(spark):
    i = instances.grid(spark, 3, 4, 8)
    r = Regime("D", (-1, 2), (1, 3), ("A",), None)
    g, at = S.local(i, r), DC.places(i)
    for p in list(S.plans(g, 2, *S.window(g, 2, r.eps)))[:6]:
        pinned = {u: int(p[u]) for u in range(0, 12, 2)}
        got = DC.decide(g, at, 2, 0, r, 100_000, pinned=pinned)
        assert got.status == "feasible" and all(got.plan[u] == j for u, j in pinned.items())


def test_brackets_hold_the_exact_spectrum_and_make_run_documents(spark, tmp_path):
    i = instances.grid(spark, 3, 4, 5, counties=2)
    regimes = [Regime(p, (0, 1), (1, 4), ("A",), c) for p in "DR" for c in (None, 0)] + [Regime("D", (0, 1), (0, 1), ("A",), 0)]
    held = [S.local(i, r) for r in regimes]
    exact = [S.spectrum(g, 2, r) for g, r in zip(held, regimes)]
    state, log = DC.brackets(i, 2, regimes, 50, finer=4)
    for s, e in zip(state, exact):
        assert (s is None) == (e[0] is None)
        for q, b in (s or {}).items():
            m = e[q - 1][0]
            assert m < Fraction(b.hi, 200) and (b.lo < 0 or Fraction(b.lo, 200) <= m) and (b.lo >= 0 or m < 0 or b.unknown)
            assert b.best is None or b.best <= m
            assert b.hi - b.lo == 1
    docs = DC.run_documents(i, "G", 2, regimes[:2], 50).cache()
    for k, text in enumerate(docs.drop("state", "party").toJSON().collect()):
        (tmp_path / f"{k}.json").write_text(json.dumps(json.loads(text)))
    back = runs.read_runs(spark, {"t": str(tmp_path / "*.json")})
    facts = runs.facts(back)
    assert back.count() == 2 and {x.state for x in facts.collect()} == {"G"} and B.violations(facts).isEmpty()
    plans = [(f"{a[0]}-{a[1]}-{a[2]}", 2, u, int(x)) for a in log if a[9] for u, x in enumerate(a[9])]
    df = spark.createDataFrame(sorted(set(plans)), "plan string, k int, atom_id int, district int")
    assert verify(i, df, Regime("D", (0, 1), (1, 4), ("A",), None)).where("NOT valid").isEmpty()


def test_unknown_points_are_passed_by():
    b = DC.Bracket(0, 16, [])
    asked = []
    while (i := b.next(3)) is not None:
        asked.append(i)
        b.unknown.append(i)
    assert len(asked) == 3 == len(set(asked)) and asked[0] == 8 and any(i < 8 for i in asked) and any(i > 8 for i in asked)
    assert DC.Bracket(-1, 5, [0]).next(3) is None and DC.Bracket(3, 4, []).next(3) is None
