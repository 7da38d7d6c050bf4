"""Lower ends by search, counted only where the independent verifier accepts the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.model import Instance, Regime
from planlens.operators import search as S
from planlens.operators.graphs import _cut as cut
from planlens.plans import verify


def sigma_search(inst: Instance, regime: Regime, k: int, seeds: int = 8, steps: int = 200) -> DataFrame:
    """q, plan, margin: the valid plan of largest q-th margin found for each q, ties to the first by name; q without one is left out."""
    found = cut(S.search_each(inst, regime, k, seeds, steps))
    checked = verify.verify(inst, found.select("plan", "k", "atom_id", "district"), regime).where("valid").select("plan", "margins")
    q = found.select("q", "plan").distinct().join(checked, "plan")
    nth = F.element_at(F.reverse(F.array_sort("margins")), F.col("q"))
    return q.groupBy("q").agg(F.min(F.struct((-nth).alias("m"), "plan")).alias("b")).select("q", F.col("b.plan").alias("plan"), (-F.col("b.m")).alias("margin"))


def best_lower_bound(inst: Instance, regime: Regime, k: int, seeds: int = 8, steps: int = 200) -> DataFrame:
    """plan, safe: the valid plan with most safe districts found for any q, ties to the first by name; no row if there is none."""
    found = cut(S.search_each(inst, regime, k, seeds, steps))
    checked = verify.verify(inst, found.select("plan", "k", "atom_id", "district"), regime).where("valid")
    best = checked.agg(F.min(F.struct((-F.col("safe")).alias("s"), "plan")).alias("b")).where("b is not null")
    return best.select(F.col("b.plan").alias("plan"), (-F.col("b.s")).alias("safe"))
