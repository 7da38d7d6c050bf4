"""Seat curves of many plans, ensemble weights, and floors under the distance of any curve from the ensemble's mean."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.model import Instance
from planlens.operators import districts as D
from planlens.shipping import ship

#: A district of more atoms than this has no count of trees: the count takes a dense determinant of that size.
MOST_ATOMS = 4000


def expected_curve(margins: DataFrame, swings: range, sigma: float) -> DataFrame:
    """plan, swing (points), seats: expected seats where each district's share has a normal error of this deviation."""
    ship(margins.sparkSession)

    @F.pandas_udf("double")
    def won(m: pd.Series) -> pd.Series:
        return m.map(lambda x: 0.5 * math.erfc(-x / (sigma * math.sqrt(2))))

    s = F.explode(F.array(*map(F.lit, swings)))
    return margins.select("plan", "margin", s.alias("swing")).withColumn("won", won(F.col("margin") + F.col("swing") / 100)).groupBy("plan", "swing").agg(F.sum("won").alias("seats"))


def spanning_trees(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, log_trees: the logarithm of the product over districts of their numbers of spanning trees, minus infinity where one isn't connected.

    A district is a task's group; those of more than MOST_ATOMS atoms raise.
    """
    ship(plans.sparkSession)
    side = lambda c: plans.select("plan", F.col("atom_id").alias(c), F.col("district").alias(f"d{c}"))
    inside = inst.edge.select("u", "v").join(side("u"), "u").join(side("v"), ["plan", "v"]).where("du = dv").select("plan", F.col("du").alias("district"), "u", "v")
    one = plans.select("plan", "district", F.col("atom_id").alias("u"), F.col("atom_id").alias("v"))

    def count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(g[["u", "v"]].to_numpy(), return_inverse=True)
        n, at = len(ids), at.reshape(-1, 2)
        if n > MOST_ATOMS:
            raise ValueError(f"district {key} has {n} atoms; trees are counted up to {MOST_ATOMS}")
        lap = np.zeros((n, n))
        for a, b in at[at[:, 0] != at[:, 1]]:
            lap[a, b] -= 1
            lap[b, a] -= 1
            lap[a, a] += 1
            lap[b, b] += 1
        sign, log = np.linalg.slogdet(lap[1:, 1:]) if n > 1 else (1.0, 0.0)
        # Numbers of trees are whole: a determinant below one half is none at all.
        return pd.DataFrame({"plan": [key[0]], "log": [log if sign > 0 and log > math.log(0.5) else -math.inf]})

    each = one.unionByName(inside).groupBy("plan", "district").applyInPandas(count, "plan string, log double")
    return each.groupBy("plan").agg(F.sum("log").alias("log_trees"))


def weights(inst: Instance, plans: DataFrame, beta: float = 1.0) -> DataFrame:
    """plan, uniform, trees, cuts: weights of the plans by number, by spanning trees, and by exp(-beta * cut edges), each of sum 1."""
    cut = D.cut_edges(inst, plans).groupBy("plan").agg(F.sum("edges").alias("edges"))
    logs = spanning_trees(inst, plans).join(cut, "plan", "left").select("plan", "log_trees", (F.coalesce("edges", F.lit(0)) * -beta).alias("log_cuts"))
    top = logs.agg(F.max("log_trees").alias("top_trees"), F.max("log_cuts").alias("top_cuts"))
    raw = logs.join(top).select("plan", F.lit(1.0).alias("uniform"), F.exp(F.col("log_trees") - F.col("top_trees")).alias("trees"), F.exp(F.col("log_cuts") - F.col("top_cuts")).alias("cuts"))
    total = raw.agg(*[F.sum(c).alias(f"all_{c}") for c in ("uniform", "trees", "cuts")])
    return raw.join(total).select("plan", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("uniform", "trees", "cuts")])


def mean_curve(curves: DataFrame, weight: DataFrame) -> DataFrame:
    """swing, mu: the curves' (plan, swing, seats) mean under weights (plan, weight)."""
    return curves.join(weight, "plan").groupBy("swing").agg((F.sum(F.col("weight") * F.col("seats")) / F.sum("weight")).alias("mu"))


def distances(curves: DataFrame, mean: DataFrame, seats: int) -> DataFrame:
    """plan, gamma, g: each curve's mean and root mean square distance from the mean curve, as shares of the seats."""
    d = curves.join(mean, "swing").withColumn("off", (F.col("seats") - F.col("mu")) / seats)
    return d.groupBy("plan").agg(F.avg("off").alias("gamma"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("g"))


def pointwise_floor(mean: DataFrame, seats: int) -> DataFrame:
    """floor: no curve of whole seats lies nearer to the mean curve than this."""
    off = F.col("mu") - F.bround("mu")
    return mean.agg((F.sqrt(F.avg(off * off)) / seats).alias("floor"))


def integrality_floor(mean: DataFrame, seats: int) -> DataFrame:
    """floor: no rising curve of whole seats lies nearer to the mean curve than this; exact.

    The mean curve has one row a swing, a fixed grid; the least cost of ending at each number of seats is carried along it.
    """
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("swing", "mu"))), lambda r: r["mu"])
    levels = F.array(*[F.lit(float(s)) for s in range(seats + 1)])

    def least_so_far(costs: Column) -> Column:
        grow = lambda acc, c: F.concat(acc, F.array(F.when(F.size(acc) == 0, c).otherwise(F.least(c, F.element_at(acc, -1)))))
        return F.aggregate(costs, F.array().cast("array<double>"), lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).otherwise(grow(acc, c)))

    step = lambda costs, mu: F.zip_with(least_so_far(costs), levels, lambda c, s: c + (s - mu) * (s - mu))
    best = F.array_min(F.aggregate(in_order, F.transform(levels, lambda s: F.lit(0.0)), step))
    return mean.agg((F.sqrt(best / F.count("*")) / seats).alias("floor"))
