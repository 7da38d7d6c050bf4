"""Reports over instances and merged brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.functions import rational as R
from planlens.functions import safety
from planlens.model import Instance
from planlens.operators import brackets as B


def instance_summary(inst: Instance) -> DataFrame:
    """atoms, edges, counties, total_pop, zero_pop, and each contest's D share in percent."""
    a = inst.atom.agg(F.count("*").alias("atoms"), F.countDistinct("county").alias("counties"), F.sum("pop").alias("total_pop"), F.count_if(F.col("pop") == 0).alias("zero_pop"))
    e = inst.edge.agg(F.count("*").alias("edges"))
    return statewide(inst).join(a).join(e)


def statewide(inst: Instance, party: str = "D") -> DataFrame:
    """contest, share (percent), margin."""
    p, o = safety.party_votes(party)
    v = inst.vote.groupBy("contest").agg(F.sum(p).alias("p"), F.sum(o).alias("o"))
    m = safety.margin(F.col("p"), F.col("o"))
    return v.select("contest", safety.in_percent(m).alias("share"), m.alias("margin"))


def lookup(merged: DataFrame, state: str, party: str, q: int) -> DataFrame:
    return merged.where((F.col("state") == state) & (F.col("party") == party) & (F.col("q") == q)).select("cap", "eps", "lo", "hi", "unknown")


def capacity(merged: DataFrame, grid: DataFrame) -> DataFrame:
    """state, party, cap, eps, m_n, m_d, seats: 'a' where the frontier is exact, else 'a--b'."""
    b = B.frontier_bounds(merged, grid)
    lo, hi = F.col("f_lo").cast("string"), F.col("f_hi").cast("string")
    return b.select(*B.KEY, "m_n", "m_d", F.when(F.col("f_lo") == F.col("f_hi"), lo).otherwise(F.concat(lo, F.lit("--"), hi)).alias("seats"))


def spectrum(merged: DataFrame) -> DataFrame:
    """KEY, q, bracket as text, and whether it is wider than 1/200 + 1/10000."""
    w = R.minus(F.col("hi"), F.col("lo"))
    wide = ~F.coalesce(w["n"] * 10_000 <= 51 * w["d"], F.coalesce(F.col("lo").isNull() & (F.col("hi.n") <= 0), F.lit(False)))
    return merged.select(*B.KEY, "q", B.shown(F.col("lo"), F.col("hi")).alias("bracket"), wide.alias("wide"))


def budget_sweep(merged: DataFrame, free: DataFrame) -> DataFrame:
    """Closed brackets by cap with upper ends bounded by the geography-free bound (state, party, q, bound)."""
    return B.capped(B.budget_closure(merged).join(free, ["state", "party", "q"], "left"), "hi_c", "bound")


def tolerance(merged: DataFrame, robust: DataFrame) -> DataFrame:
    """Closed brackets by eps, and those of the scenario set (state, party, cap, eps, q, lo, hi) below the single scenario's upper end."""
    single = B.eps_closure(merged)
    r = robust.select(*B.KEY, "q", F.col("lo").alias("robust_lo"), F.col("hi").alias("robust_hi"))
    both = single.join(r, [*B.KEY, "q"], "left")
    return B.capped(both, "robust_hi", "hi")


def ablation(merged: DataFrame, bounds: DataFrame) -> DataFrame:
    """Brackets beside other upper bounds (state, party, q, free, cells, refined as fractions, search as a margin) and the points between them."""
    d = merged.join(bounds, ["state", "party", "q"])
    pts = lambda a, b: F.lit(100.0) * (R.value(F.col(a)) - R.value(F.col(b)))
    least = F.least(R.value(F.col("cells")), R.value(F.col("refined")))
    return d.select("state", "party", "q", pts("free", "hi").alias("gained"), (F.lit(100.0) * (least - R.value(F.col("free")))).alias("cells_loss"),
                    (F.lit(100.0) * (R.value(F.col("lo")) - F.when(F.col("search") >= 0, F.col("search")))).alias("over_search"))


def sanity(merged: DataFrame, seats: DataFrame, statewide_margin: DataFrame) -> DataFrame:
    """Rule breaches: order and monotone, and brackets that contradict the statewide margin (state, party, margin)."""
    d = merged.join(seats, "state").join(statewide_margin, ["state", "party"])
    lo, hi, m = R.value(F.col("lo")), R.value(F.col("hi")), F.col("margin")
    rules = F.array(
        F.when((F.col("q") == F.col("k")) & (lo > m), F.lit("all districts above statewide")),
        F.when((F.col("q") == 1) & (m >= 0) & (hi <= m), F.lit("best district below statewide")),
        F.when((F.col("q") == F.col("k")) & (m < 0) & (lo >= 0), F.lit("all safe below half")),
    )
    more = d.select(*B.KEY, "q", F.explode(F.array_compact(rules)).alias("rule"))
    return B.monotone_errors(merged).unionByName(more)


def national(bounds: DataFrame) -> DataFrame:
    """m_n, m_d, sums of the states' frontier bounds."""
    return bounds.groupBy("m_n", "m_d").agg(F.sum("f_lo").alias("f_lo"), F.sum("f_hi").alias("f_hi"))


def wide(df: DataFrame, by: list[str], over, value: str, names: list[str]) -> DataFrame:
    """by... and a column for each name: the value where `over` has it, null where none does; names not listed are left out."""
    return df.groupBy(*by).agg(*[F.max(F.when(over == n, F.col(value))).alias(f"c{i}") for i, n in enumerate(names)])


def latex_rows(df: DataFrame) -> DataFrame:
    """line: each row as a table row."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in df.columns]), F.lit(r" \\")).alias("line"))


def ladder(docs: DataFrame) -> DataFrame:
    """state, party, frac, atoms, q, width of each resolution step's bracket; docs: state, party, frac, atoms, q, lo, hi."""
    return docs.select("state", "party", "frac", "atoms", "q", B.width(F.col("lo"), F.col("hi")).alias("width"))


def headline_numbers(merged: DataFrame, seats: DataFrame, bounds: DataFrame, enacted: DataFrame, checks: DataFrame, ablations: DataFrame, audits: DataFrame, facts: DataFrame) -> DataFrame:
    """metric, value: the published numbers of one cap and eps, each from its own table.

    merged and bounds (frontier_bounds) are of that cap and eps; seats: state, k, with brackets of q > k left out;
    enacted: state, party, q, share of the enacted plan's q-th district in percent; checks: state, in_regime, violations;
    ablations: as in ablation(); audits: name, verdict; facts: unmerged, for consistency. Open widths are infinite.
    """
    q, k = F.col("q"), F.col("k")
    m = merged.join(seats, "state").where(q <= k).withColumn("w", B.width(F.col("lo"), F.col("hi")))
    tight = F.col("w") <= 0.5 + 1e-9
    median = lambda c, if_: F.median(F.when(if_, F.col(c)))
    sizes = seats.agg(F.count("*").alias("n_states"), F.sum("k").alias("seats"))
    widths = m.agg(F.count("*").alias("brackets"), F.count_if(tight).alias("tight_brackets"), F.count_if(k == 2).alias("k2_brackets"), F.count_if(tight & (k == 2)).alias("k2_tight"),
                   *[median("w", k == i).alias(f"median_k{i}") for i in (3, 4, 5)])
    same = F.col("f_lo") == F.col("f_hi")
    f = B.frontier_bounds(m, bounds.select("m_n", "m_d").distinct())
    frontier = f.join(seats, "state").agg(F.count("*").alias("F_cases"), F.count_if(same).alias("F_exact"), F.count_if(same & (k == 2)).alias("F_exact_k2"), F.count_if(same & (k > 2)).alias("F_exact_k345"))
    ranges = B.range_totals(B.seat_ranges(f.where("m_n = 0"), seats)).toDF(
        "D_verified_min", "D_verified_max", "D_limit_min", "D_limit_max", "forced_states", "R_majority_states", "D_majority_states")
    wins = enacted.where("party = 'D'").agg(F.count_if(F.col("share") > 50).alias("enacted_D"))
    valid = checks.agg(F.count_if("in_regime").alias("enacted_in_regime"), F.count("*").alias("enacted_checked"), F.sum("violations").alias("enacted_violations"))
    gaps = B.enacted_gaps(m, enacted).select(F.col("below").alias("enacted_below"), F.col("median_gap").alias("enacted_gap_median"), F.col("median_gap_first").alias("enacted_gap_q1_median"))
    # Trivial comparisons, whose free bound is 0 or less and where nothing feasible is known, don't count.
    a = ablation(m.where("lo is not null"), ablations).unionByName(ablation(m.where("lo is null"), ablations.where("free.n > 0")))
    gain, more = F.col("gained"), F.col("gained") > 0.05
    abl = a.agg(F.count("*").alias("abl_nontrivial"), F.median("cells_loss").alias("abl_quot_median"), F.min("cells_loss").alias("abl_quot_min"), F.max("cells_loss").alias("abl_quot_max"),
                F.count(gain).alias("abl_finite"), F.count_if(more).alias("abl_improved"), F.median(gain).alias("abl_impr_median"), median("gained", q == 1).alias("abl_q1_median"),
                F.min(F.when((q == 1) & more, gain)).alias("abl_q1_min"), F.max(F.when(q == 1, gain)).alias("abl_q1_max"),
                F.count("over_search").alias("recom_cmp"), F.count_if(F.col("over_search") > 0).alias("recom_cert_higher"), F.median("over_search").alias("recom_median"),
                F.min("over_search").alias("recom_min"), F.max("over_search").alias("recom_max"))
    said = lambda n, v: F.count_if((F.col("name") == n) & ((F.col("verdict") == v) if v else F.lit(True)))
    audit = audits.agg(*[said(n, v).alias(f"{label}_{v or 'total'}") for n, label in (("main", "audit"), ("k2", "audit_k2"), ("stored", "stored")) for v in ("agree", "disagree", "unknown", "")])
    broken = B.violations(facts).agg(F.count("*").alias("consistency_violations"))
    keys = facts.where("regime = 'feasible'").select(*B.KEY).distinct().agg(F.count("*").alias("consistency_keys"))

    def up(d: DataFrame) -> DataFrame:
        return d.select(*[F.col(c).cast("double").alias(c) for c in d.columns]).unpivot([], d.columns, "metric", "value")

    out = up(sizes)
    for d in (widths, frontier, ranges, wins, valid, gaps, abl, audit, broken, keys):
        out = out.unionByName(up(d))
    return out
