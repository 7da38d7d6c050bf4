"""Statistics of plans' districts. All take plans (plan, k, atom_id, district) and keep empty districts.

Districts of a plan are few (k); atoms are many. Each operator aggregates atoms once and then works on k rows a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.functions import safety
from planlens.model import Instance, Regime


def labels(plans: DataFrame) -> DataFrame:
    """Every district 0..k-1 of every plan, empty ones too."""
    return plans.select("plan", "k").distinct().select("plan", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("district"))


def district_pop(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, k, district, atoms, pop."""
    got = plans.join(inst.atom.select("atom_id", "pop"), "atom_id").groupBy("plan", "district").agg(F.count("*").alias("atoms"), F.sum("pop").alias("pop"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return labels(plans).join(got, ["plan", "district"], "left").select("plan", "k", "district", zero("atoms"), zero("pop"))


def district_votes(inst: Instance, plans: DataFrame, party: str = "D", contests: tuple[str, ...] | None = None) -> DataFrame:
    """plan, k, district, contest, p, o: own and other votes."""
    p, o = safety.party_votes(party)
    votes = inst.vote if contests is None else inst.vote.where(F.col("contest").isin(*contests))
    got = plans.join(votes, "atom_id").groupBy("plan", "district", "contest").agg(F.sum(p).alias("p"), F.sum(o).alias("o"))
    every = labels(plans).join(votes.select("contest").distinct())  # k rows a plan times the few contests
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(got, ["plan", "district", "contest"], "left").select("plan", "k", "district", "contest", zero("p"), zero("o"))


def robust_margins(inst: Instance, plans: DataFrame, regime: Regime) -> DataFrame:
    """plan, k, district, margin (the least over the contests) and safe (in every contest)."""
    p, o = F.col("p"), F.col("o")
    return district_votes(inst, plans, regime.party, regime.contests).groupBy("plan", "k", "district").agg(
        F.min(safety.margin(p, o)).alias("margin"), F.bool_and(safety.is_safe(p, o, regime.m)).alias("safe"))


def ranked(margins: DataFrame) -> DataFrame:
    """Adds q: 1 for the largest margin, ties by district; and top_sum: the sum of the q largest."""
    w = W.partitionBy("plan").orderBy(F.col("margin").desc(), "district")
    return margins.withColumn("q", F.row_number().over(w)).withColumn("top_sum", F.sum("margin").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def relabelled(plans: DataFrame, margins: DataFrame) -> DataFrame:
    """Plans with districts numbered from the safest on."""
    new = ranked(margins).select("plan", "district", (F.col("q") - 1).cast("int").alias("new"))
    return plans.join(new, ["plan", "district"]).select("plan", "k", "atom_id", F.col("new").alias("district"))


def safe_count(margins: DataFrame) -> DataFrame:
    return margins.groupBy("plan").agg(F.count_if("safe").alias("safe"))


def county_splits(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, splits: over counties, the number of districts met, less one."""
    met = plans.join(inst.atom.select("atom_id", "county"), "atom_id").select("plan", "county", "district").distinct()
    return met.groupBy("plan", "county").agg(F.count("*").alias("n")).groupBy("plan").agg(F.sum(F.col("n") - 1).alias("splits"))


def max_pop_deviation(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, deviation: the largest |pop * k / T - 1|, over districts that exist."""
    pops = district_pop(inst, plans).where("atoms > 0")
    total = pops.groupBy("plan").agg(F.sum("pop").alias("total"))
    return pops.join(total, "plan").groupBy("plan").agg(F.max(F.abs(F.col("pop") * F.col("k") / F.col("total") - 1)).alias("deviation"))


def frontier(margins: DataFrame, grid: DataFrame) -> DataFrame:
    """plan, m_n, m_d, seats: districts with a margin of at least m, for m in grid (m_n, m_d)."""
    hit = F.col("margin") >= F.col("m_n") / F.col("m_d")
    return margins.join(F.broadcast(grid)).groupBy("plan", "m_n", "m_d").agg(F.count_if(hit).alias("seats"))


def best_over_plans(margins: DataFrame) -> DataFrame:
    """k, q, sigma: the largest q-th margin over all plans of k districts."""
    return ranked(margins).groupBy("k", "q").agg(F.max("margin").alias("sigma"))


def layer_cake(margins: DataFrame) -> DataFrame:
    """plan, area: the sum of positive margins, which is the area under the plan's frontier from 0 on."""
    return margins.groupBy("plan").agg(F.sum(F.greatest("margin", F.lit(0.0))).alias("area"))


def cut_edges(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, a, b, edges: edges between districts a < b."""
    d = plans.select("plan", "atom_id", "district")
    both = inst.edge.join(d.withColumnsRenamed({"atom_id": "u", "district": "du"}), "u").join(d.withColumnsRenamed({"atom_id": "v", "district": "dv"}), ["plan", "v"])
    return both.where("du != dv").groupBy("plan", F.least("du", "dv").alias("a"), F.greatest("du", "dv").alias("b")).agg(F.count("*").alias("edges"))


def boundary_counties(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, county: counties that are split, or have an edge into another county and another district."""
    d = plans.join(inst.atom.select("atom_id", "county"), "atom_id").select("plan", "atom_id", "district", "county")
    side = lambda s: d.withColumnsRenamed({"atom_id": s, "district": f"d{s}", "county": f"c{s}"})
    cross = inst.edge.join(side("u"), "u").join(side("v"), ["plan", "v"]).where("cu != cv and du != dv")
    split = d.groupBy("plan", "county").agg(F.min("district").alias("lo"), F.max("district").alias("hi")).where("lo != hi").select("plan", "county")
    return cross.select("plan", F.col("cu").alias("county")).unionByName(cross.select("plan", F.col("cv").alias("county"))).unionByName(split).distinct()


def county_adjacency(inst: Instance) -> DataFrame:
    """a < b: counties with an edge between them."""
    c = inst.atom.select("atom_id", "county")
    both = inst.edge.join(c.withColumnsRenamed({"atom_id": "u", "county": "cu"}), "u").join(c.withColumnsRenamed({"atom_id": "v", "county": "cv"}), "v")
    return both.where("cu != cv").select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).distinct()


def free_counties(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, county: counties in one district only, which a neighbourhood search may pin."""
    d = plans.join(inst.atom.select("atom_id", "county"), "atom_id").groupBy("plan", "county").agg(F.min("district").alias("lo"), F.max("district").alias("hi"))
    return d.where("lo = hi").select("plan", "county")


def first_used_atom(plans: DataFrame) -> DataFrame:
    """plan, district, root: the least atom of each district, its canonical root."""
    return plans.groupBy("plan", "district").agg(F.min("atom_id").alias("root"))


def swapped(inst: Instance) -> Instance:
    """The instance with the parties exchanged."""
    return Instance(inst.atom, inst.vote.select("atom_id", "contest", F.col("r").alias("d"), F.col("d").alias("r")), inst.edge)


def seat_curve(margins: DataFrame, swings: range) -> DataFrame:
    """plan, swing (points), seats: districts won after a uniform swing."""
    s = F.explode(F.array(*map(F.lit, swings)))
    return margins.select("plan", "margin", s.alias("swing")).groupBy("plan", "swing").agg(F.count_if(F.col("margin") + F.col("swing") / 100 >= 0).alias("seats"))
