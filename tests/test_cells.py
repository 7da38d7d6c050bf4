"""Rankings by density against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from planlens.operators import cells as C


@pytest.mark.parametrize("upper", [True, False])
def test_ranked_with_a_hot_density_and_small_groups(spark, upper):
    rng = random.Random(3)
    # Group 1: a third has density 0, a third density 2; group 2 has one atom; group 3 has negative masses and large numbers.
    rows = [(1, i, 1 + i % 5, 0 if i % 3 == 0 else 2 * (1 + i % 5) if i % 3 == 1 else rng.randint(-50, 50)) for i in range(3000)]
    rows += [(2, 7, 3, -4)] + [(3, 9_000 + i, rng.randint(1, 10**6), rng.randint(-(10**9), 10**9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, atom_id int, pop long, mass long").repartition(7)
    want = []
    for g in (1, 2, 3):
        x = v = 0
        sign = -1 if upper else 1
        for t, (_, a, p, m) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (sign * r[3] / r[2], r[1]))):
            want.append((g, a, p, m, t, x, v))
            x, v = x + p, v + m
    for buckets in (2, 16, 200):
        assert sorted(tuple(r) for r in C.ranked(df, ["g"], F.col("mass") / F.col("pop") * (-1 if upper else 1), {"x": "pop", "v": "mass"}, buckets).collect()) == sorted(want)


def test_ranked_of_nothing(spark):
    assert C.ranked(spark.createDataFrame([], "g int, atom_id int, pop long, mass long"), ["g"], F.col("mass") / F.col("pop"), {"x": "pop"}).count() == 0


def test_ranked_with_nulls_first(spark):
    rows = [(1, i, None if i % 2 else float(i % 3)) for i in range(60)] + [(2, i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, atom_id int, r double")
    got = {(x.g, x.atom_id): x.t for x in C.ranked(df, ["g"], F.col("r"), {}, 8).collect()}
    for g in (1, 2):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))
        assert [got[g, r[1]] for r in order] == list(range(len(order)))
