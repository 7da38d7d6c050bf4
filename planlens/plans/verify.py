"""Verification of plans from raw tables, as one relational pipeline. It shares no code with the search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.functions import safety
from planlens.model import Instance, Regime
from planlens.operators import districts as D
from planlens.operators.graphs import district_components


def verify(inst: Instance, plans: DataFrame, regime: Regime) -> DataFrame:
    """plan, k, valid, safe, splits, errors, margins (by district): whether each plan is one, and how many districts are safe.

    A plan is valid if all atoms have one district 0..k-1, no district is empty, each is connected and within the
    population window, and the split budget holds.
    """
    n = inst.atom.agg(F.count("*").alias("n"), F.sum("pop").alias("total"))
    labels = plans.groupBy("plan", "k").agg(
        F.count("*").alias("rows"), F.countDistinct("atom_id").alias("atoms"), F.count_if((F.col("district") < 0) | (F.col("district") >= F.col("k")) | F.col("district").isNull()).alias("bad"))
    labels = labels.join(n)
    size = F.when((F.col("rows") != F.col("n")) | (F.col("atoms") != F.col("n")), F.lit("wrong length"))
    range_ = F.when(F.col("bad") > 0, F.lit("label out of range"))
    lo, hi = safety.pop_window(F.col("total"), F.col("k"), regime.eps)
    head = labels.select("plan", "k", F.array_compact(F.array(size, range_)).alias("head"), lo.alias("lo"), hi.alias("hi"))
    good = plans.where((F.col("district") >= 0) & (F.col("district") < F.col("k")))
    pops = D.district_pop(inst, good).join(district_components(inst, good), ["plan", "district"], "left").join(head.select("plan", "lo", "hi"), "plan")
    name = F.concat(F.lit("district "), F.col("district").cast("string"))
    empty = F.when(F.col("atoms") == 0, F.concat(name, F.lit(" empty")))
    pop = F.when((F.col("atoms") > 0) & ~F.col("pop").between(F.col("lo"), F.col("hi")), F.concat(name, F.lit(" population")))
    apart = F.when(F.coalesce("parts", F.lit(1)) > 1, F.concat(name, F.lit(" not connected")))
    errors = pops.select("plan", "district", F.array_compact(F.array(empty, pop, apart)).alias("e"))
    margins = D.robust_margins(inst, good, regime)
    each = margins.join(errors, ["plan", "district"]).groupBy("plan").agg(
        F.count_if("safe").alias("safe"), F.sort_array(F.collect_list(F.struct("district", "margin", "e"))).alias("rows"))
    out = head.join(each, "plan", "left").join(D.county_splits(inst, good), "plan", "left")
    cap = F.array().cast("array<string>") if regime.cap is None else F.array_compact(F.array(F.when(F.col("splits") > regime.cap, F.lit("too many county splits"))))
    rows = F.coalesce(F.flatten(F.transform("rows", lambda r: r["e"])), F.array().cast("array<string>"))
    found = F.concat("head", rows, cap)
    return out.select("plan", "k", (F.size(found) == 0).alias("valid"), F.coalesce("safe", F.lit(0)).alias("safe"), F.coalesce("splits", F.lit(0)).alias("splits"),
                      found.alias("errors"), F.transform("rows", lambda r: r["margin"]).alias("margins"))


def reverify(inst: Instance, plans: DataFrame, claims: DataFrame, regime: Regime) -> DataFrame:
    """Claims (plan, q, margin as a fraction) whose plan isn't valid or whose q-th margin isn't the claimed one."""
    checked = verify(inst, plans, regime).select("plan", "valid")
    ranked = D.ranked(D.robust_margins(inst, plans, regime)).select("plan", "q", F.col("margin").alias("found"))
    both = claims.join(checked, "plan", "left").join(ranked, ["plan", "q"], "left")
    same = F.abs(F.col("margin.n") / F.col("margin.d") - F.col("found")) < 1e-15
    return both.where(~F.coalesce(F.col("valid") & same, F.lit(False)))
