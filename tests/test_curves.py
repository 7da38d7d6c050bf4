"""Curves and floors against brute force."""

import itertools
import math

import numpy as np
import pytest

from planlens.model import Instance
from planlens.operators import curves as K


def test_integrality_floor_against_all_rising_curves(spark):
    rng = np.random.default_rng(1)
    for seats, swings in ((3, 5), (2, 6), (1, 1)):
        mu = (rng.random(swings) * (seats + 1) - 0.5).tolist()
        mean = spark.createDataFrame(list(enumerate(mu)), "swing int, mu double").repartition(3)
        best = min(np.mean([(f - m) ** 2 for f, m in zip(c, mu)]) for c in itertools.combinations_with_replacement(range(seats + 1), swings))
        assert K.integrality_floor(mean, seats).first().floor == pytest.approx(math.sqrt(best) / seats)
        assert K.pointwise_floor(mean, seats).first().floor <= math.sqrt(np.mean([min((f - m) ** 2 for f in range(-1, seats + 2)) for m in mu])) / seats + 1e-12


def test_spanning_trees_of_grids(spark):
    n = 3
    edge = [(i, i + 1) for i in range(9) if i % n < n - 1] + [(i, i + n) for i in range(6)]
    inst = Instance(None, None, spark.createDataFrame(edge, "u int, v int"))
    label = {"one": lambda i: 0, "rows": lambda i: i // n, "two": lambda i: int(i >= 6), "apart": lambda i: i % 2}
    plans = spark.createDataFrame([(p, 3, i, f(i)) for p, f in label.items() for i in range(9)], "plan string, k int, atom_id int, district int")
    got = {r.plan: r.log_trees for r in K.spanning_trees(inst, plans).collect()}
    assert math.exp(got["one"]) == pytest.approx(192) and got["rows"] == pytest.approx(0) and math.exp(got["two"]) == pytest.approx(15)
    assert got["apart"] == -math.inf
    w = {r.plan: r for r in K.weights(inst, plans).collect()}
    assert sum(r.trees for r in w.values()) == pytest.approx(1) and w["apart"].trees == 0 and w["one"].trees == pytest.approx(192 / (192 + 1 + 15))
    cuts = {p: sum(f(u) != f(v) for u, v in edge) for p, f in label.items()}
    assert w["two"].cuts == pytest.approx(math.exp(-cuts["two"]) / sum(math.exp(-c) for c in cuts.values()))


def test_expected_curve(spark):
    margins = spark.createDataFrame([("a", 0, 0.02), ("a", 1, -0.1)], "plan string, district int, margin double")
    got = {r.swing: r.seats for r in K.expected_curve(margins, range(-2, 3), 0.05).collect()}
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert got == pytest.approx({s: sum(cdf((m + s / 100) / 0.05) for m in (0.02, -0.1)) for s in range(-2, 3)})
