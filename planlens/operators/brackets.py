"""Certified brackets [lo, hi) of the q-th largest margin: merging, closure, checks and frontiers.

Facts have one row for each run and q: tag, state, party, cap, eps, q, regime, seconds, lo, hi (fractions; a null lo
means that nothing feasible is known, a null hi that no bound is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.functions import rational as R

KEY = ["state", "party", "cap", "eps"]
#: Width up to which a bracket counts as settled.
SETTLED = (1, 200)


def best(r: str, largest: bool) -> Column:
    """The largest or least fraction of a group, found by its order-exact value."""
    c = F.col(r)
    return (F.max_by if largest else F.min_by)(c, F.when(c.isNotNull(), R.value(c)))


def unsettled(lo: Column, hi: Column) -> Column:
    """No upper end, or a width over SETTLED; nothing feasible and an upper end of 0 or less is settled."""
    n, d = SETTLED
    w = R.minus(hi, lo)
    narrow = F.when(lo.isNull(), hi["n"] <= 0).otherwise(w["n"] * d <= n * w["d"])
    return ~F.coalesce(hi.isNotNull() & narrow, F.lit(False))


def merge(facts: DataFrame) -> DataFrame:
    """state, party, cap, eps, q, lo, hi, unknown, seconds: the largest lo and least hi of feasible runs; seconds of all runs."""
    ok = facts.where(F.col("regime") == "feasible").groupBy(*KEY, "q").agg(best("lo", True).alias("lo"), best("hi", False).alias("hi"))
    seconds = facts.groupBy(*KEY).agg(F.sum("seconds").alias("seconds"))
    return ok.join(seconds, KEY).withColumn("unknown", unsettled(F.col("lo"), F.col("hi")))


def violations(facts: DataFrame) -> DataFrame:
    """Keys and q whose best lo isn't below the best hi, over all feasible runs."""
    return merge(facts).where(R.at_least(F.col("lo"), F.col("hi"))).drop("unknown", "seconds")


def frontier_bounds(merged: DataFrame, grid: DataFrame) -> DataFrame:
    """KEY, m_n, m_d, f_lo, f_hi: the largest q known to reach m, and the largest not excluded; 0 if none."""
    m = F.struct(F.col("m_n").alias("n"), F.col("m_d").alias("d"))
    lo, hi, q = F.col("lo"), F.col("hi"), F.col("q")
    reached = F.max(F.when(lo.isNotNull() & R.at_least(lo, m), q))
    open_ = F.max(F.when(hi.isNull() | R.less(m, hi), q))
    return merged.join(F.broadcast(grid)).groupBy(*KEY, "m_n", "m_d").agg(F.coalesce(reached, F.lit(0)).alias("f_lo"), F.coalesce(open_, F.lit(0)).alias("f_hi"))


def width(lo: Column, hi: Column) -> Column:
    """In points of share: 0 if nothing reaches 0 for sure, infinite if an end is open."""
    w = R.minus(hi, lo)
    return F.when(lo.isNull() & hi.isNotNull() & (hi["n"] <= 0), F.lit(0.0)).when(lo.isNull() | hi.isNull(), F.lit(float("inf"))).otherwise(F.lit(100.0) * w["n"] / w["d"])


def tightness(merged: DataFrame, by: list[str]) -> DataFrame:
    """Counts of widths up to 0.5, 1, 2 and 3 points and the median of finite ones."""
    w = F.col("w")
    upto = lambda x, name: F.count_if(w <= x).alias(name)
    d = merged.withColumn("w", width(F.col("lo"), F.col("hi")))
    return d.groupBy(*by).agg(F.count("*").alias("brackets"), upto(0.5, "le_half"), upto(1.0, "le_1"), upto(2.0, "le_2"), upto(3.0, "le_3"),
                              F.median(F.when(w < float("inf"), w)).alias("median_width"))


def _running(c: str, largest: bool, window) -> Column:
    """A running largest or least fraction; the window's order is by the closed-over column."""
    x = F.col(c)
    keyed = F.struct(R.value(x).alias("v"), x["n"].alias("n"), x["d"].alias("d"))
    got = (F.max if largest else F.min)(F.when(x.isNotNull(), keyed)).over(window)
    return F.when(got.isNotNull(), F.struct(got["n"].alias("n"), got["d"].alias("d")))


def closure(merged: DataFrame, over: Column, by: list[str]) -> DataFrame:
    """Brackets after monotone closure: what is feasible for less of `over` is for more; what is excluded for more is for less."""
    w = W.partitionBy(*by).orderBy(over)
    up, down = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.currentRow, W.unboundedFollowing)
    return merged.withColumn("lo_c", _running("lo", True, up)).withColumn("hi_c", _running("hi", False, down))


def budget_closure(merged: DataFrame) -> DataFrame:
    return closure(merged, F.col("cap"), ["state", "party", "eps", "q"])


def eps_value(eps: str = "eps") -> Column:
    return R.value(R.parse(F.col(eps)))


def eps_closure(merged: DataFrame) -> DataFrame:
    return closure(merged, eps_value(), ["state", "party", "cap", "q"])


def capped(d: DataFrame, hi: str, by: str) -> DataFrame:
    """hi bounded by another bound (null: none)."""
    a, b = F.col(hi), F.col(by)
    return d.withColumn(hi, F.when(a.isNull(), b).when(b.isNull(), a).when(R.less(b, a), b).otherwise(a))


def propagated(merged: DataFrame) -> DataFrame:
    """hi_prev: the least hi at q or below; q districts of a margin are q - 1 of it too."""
    w = W.partitionBy(*KEY).orderBy("q").rowsBetween(W.unboundedPreceding, W.currentRow)
    return merged.withColumn("hi_prev", _running("hi", False, w))


def monotone_errors(merged: DataFrame) -> DataFrame:
    """Rows with lo at or above hi (rule 'order'), or above the last known lo of a smaller q ('monotone')."""
    w = W.partitionBy(*KEY).orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    d = merged.withColumn("prev", F.last("lo", ignorenulls=True).over(w))
    order = F.when(R.at_least(F.col("lo"), F.col("hi")), F.lit("order"))
    mono = F.when(R.less(F.col("prev"), F.col("lo")), F.lit("monotone"))
    return d.select(*KEY, "q", F.explode(F.filter(F.array(order, mono), lambda x: x.isNotNull())).alias("rule"))


def unresolved(merged: DataFrame, gap: tuple[int, int], null_is_open: bool = True) -> DataFrame:
    """Brackets wider than gap; an open end counts as wide if null_is_open."""
    w = R.minus(F.col("hi"), F.col("lo"))
    wide = w["n"] * gap[1] > gap[0] * w["d"]
    return merged.where(F.coalesce(wide, F.lit(null_is_open)) & ~F.coalesce(F.col("lo").isNull() & (F.col("hi.n") <= 0), F.lit(False)))


def open_jobs(merged: DataFrame, gap: tuple[int, int], rule: str, seats: DataFrame | None = None) -> DataFrame:
    """KEY of jobs with a bracket wider than gap.

    Rule 'escalate': any open end counts as wide, but not where nothing reaches 0 for sure. Rule 'sweep': only brackets
    of q below the state's seats (state, k) with a positive upper end count, and no known lower end counts as wide.
    """
    lo, hi = F.col("lo"), F.col("hi")
    w = R.minus(hi, lo)
    wide = w["n"] * gap[1] > gap[0] * w["d"]
    if rule == "escalate":
        d = merged.where(~F.coalesce(lo.isNull() & (hi["n"] <= 0), F.lit(False)) & F.coalesce(wide, F.lit(True)))
    elif rule == "sweep":
        d = merged.join(seats, "state").where((F.col("q") < F.col("k")) & (hi["n"] > 0) & (lo.isNull() | wide))
    else:
        raise ValueError(f"no such rule: {rule}")
    return d.select(*KEY).distinct()


def named_jobs(jobs: DataFrame, names: list[str]) -> DataFrame:
    """Jobs whose state_party is one of the names; all where there are none."""
    return jobs.where(F.concat_ws("_", "state", "party").isin(names)) if names else jobs


def seat_ranges(bounds: DataFrame, seats: DataFrame) -> DataFrame:
    """state, k, verified and limiting seat ranges of D from both parties' bounds (of one cap, eps and margin). seats: state, k."""
    d = bounds.where("party = 'D'").select("state", F.col("f_lo").alias("d_lo"), F.col("f_hi").alias("d_hi"))
    r = bounds.where("party = 'R'").select("state", F.col("f_lo").alias("r_lo"), F.col("f_hi").alias("r_hi"))
    k = F.col("k")
    return seats.join(d, "state").join(r, "state").select("state", "k", (k - F.col("r_lo")).alias("ver_min"), F.col("d_lo").alias("ver_max"),
                                                          (k - F.col("r_hi")).alias("lim_min"), F.col("d_hi").alias("lim_max"))


def against_plans(merged: DataFrame, sigma: DataFrame) -> DataFrame:
    """Brackets with the q-th margin (KEY..., q, margin) of a known plan: refuted if it reaches hi, beaten if it passes lo."""
    lo, hi = F.col("lo"), F.col("hi")
    both = merged.join(sigma, ["state", "party", "q"])
    return both.withColumn("refuted", F.coalesce(F.col("margin") >= R.value(hi), F.lit(False))).withColumn("beaten", F.coalesce(F.col("margin") > R.value(lo), F.lit(False)))


def shown(lo: Column, hi: Column) -> Column:
    """A bracket as text, in percent of share."""
    pct = lambda r, d: F.format_number(R.percent(r), d)
    return (
        F.when(lo.isNull() & hi.isNotNull() & (hi["n"] <= 0), F.lit("<50"))
        .when(lo.isNull() & hi.isNull(), F.lit("--"))
        .when(lo.isNull(), F.concat(F.lit("<"), pct(hi, 1)))
        .otherwise(F.concat(pct(lo, 2), F.lit("--"), F.when(hi.isNull(), F.lit("inf")).otherwise(pct(hi, 1))))
    )


def tightest_proof(records: DataFrame) -> DataFrame:
    """state, party, q and the least fraction m of their infeasible records; records without a numeric m are left out."""
    m = R.parse(F.col("m"))
    return records.where((F.col("status") == "infeasible") & m.isNotNull()).withColumn("mm", m).groupBy("state", "party", "q").agg(best("mm", False).alias("m"))


def tallies(audits: DataFrame) -> DataFrame:
    """agree, disagree, unknown, total of a column verdict; unknown never counts as agreement."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return audits.agg(n("agree"), n("disagree"), n("unknown"), F.count("*").alias("total"))


def solver_scores(results: DataFrame, solvers: list[str], limit: float) -> DataFrame:
    """solver, decided, median_seconds, contradictions, from results with a struct<status,seconds> column for each solver."""
    answers = F.array(*[F.struct(F.lit(s).alias("solver"), F.col(f"{s}.status").alias("status"), F.col(f"{s}.seconds").alias("seconds")) for s in solvers])
    said = lambda v: F.exists(answers, lambda a: a["status"] == v)
    d = results.select((said("feasible") & said("infeasible")).alias("clash"), F.explode(answers).alias("a")).select("clash", "a.*")
    done = F.col("status").isin("feasible", "infeasible") & (F.col("seconds") <= limit)
    return d.groupBy("solver").agg(F.count_if(done).alias("decided"), F.median(F.when(done, F.col("seconds"))).alias("median_seconds"), F.count_if("clash").alias("contradictions"))


def headline(merged: DataFrame, bounds: DataFrame) -> DataFrame:
    """metric, value: brackets, tight ones, median width of all (open ends infinite), frontier cases and exact ones."""
    w = merged.select(width(F.col("lo"), F.col("hi")).alias("w"))
    a = w.agg(F.count("*").alias("brackets"), F.count_if(F.col("w") <= 0.5).alias("tight"), F.median("w").alias("median_width"))
    b = bounds.agg(F.count("*").alias("cases"), F.count_if(F.col("f_lo") == F.col("f_hi")).alias("exact"))
    up = lambda d, names: d.unpivot([], names, "metric", "value")
    dbl = lambda d: d.select(*[F.col(c).cast("double").alias(c) for c in d.columns])
    return up(dbl(a), ["brackets", "tight", "median_width"]).unionByName(up(dbl(b), ["cases", "exact"]))


def proof_keys(records: DataFrame) -> DataFrame:
    """state, party, q, m, cap, eps, contests of infeasible records with a numeric m, each key once."""
    found = records.where((F.col("status") == "infeasible") & R.parse(F.col("m")).isNotNull())
    return found.select("state", "party", "q", "m", "cap", "eps", "contests").dropDuplicates()


def range_totals(ranges: DataFrame) -> DataFrame:
    """Sums of seat ranges over states, states where all four ends agree, and states where a majority is known for either party."""
    k, lo, hi = F.col("k"), F.col("ver_min"), F.col("ver_max")
    total = [F.sum(c).alias(c) for c in ("ver_min", "ver_max", "lim_min", "lim_max")]
    forced = (lo == hi) & (hi == F.col("lim_min")) & (F.col("lim_min") == F.col("lim_max"))
    return ranges.agg(*total, F.count_if(forced).alias("forced"), F.count_if((k - lo) * 2 > k).alias("other_majority"), F.count_if(hi * 2 > k).alias("own_majority"))


def enacted_gaps(merged: DataFrame, shares: DataFrame) -> DataFrame:
    """How far lower ends above one half lie over an enacted plan's q-th share in percent (state, party, q, share)."""
    g = merged.where("lo.n > 0").join(shares, ["state", "party", "q"]).select("q", (F.lit(100.0) * R.value(F.col("lo")) + 50.0 - F.col("share")).alias("gap"))
    return g.agg(F.count("*").alias("compared"), F.count_if(F.col("gap") > 0).alias("below"), F.median("gap").alias("median_gap"), F.median(F.when(F.col("q") == 1, F.col("gap"))).alias("median_gap_first"))
