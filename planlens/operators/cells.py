"""Cells (groups of atoms), their quotient graphs, and envelopes of safety mass over population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.functions import safety
from planlens.model import Instance, Regime
from planlens.operators.graphs import _cut as cut


def quotient_edges(edge: DataFrame, cell_of: DataFrame) -> DataFrame:
    """a < b: cells (atom_id, cell) with an edge between them."""
    side = lambda s: cell_of.select(F.col("atom_id").alias(s), F.col("cell").alias(f"c{s}"))
    both = edge.join(side("u"), "u").join(side("v"), "v").where("cu != cv")
    return both.select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).distinct()


def coarsen(inst: Instance, cell_of: DataFrame) -> Instance:
    """The instance whose atoms are cells: sums, least county, centroid weighted by population (1 at least)."""
    w = F.greatest("pop", F.lit(1))
    a = inst.atom.join(cell_of, "atom_id").groupBy(F.col("cell").alias("atom_id")).agg(
        F.min("geoid").alias("geoid"), F.min("county").alias("county"), F.sum("pop").alias("pop"),
        (F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"))
    v = inst.vote.join(cell_of, "atom_id").groupBy(F.col("cell").alias("atom_id"), "contest").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    return Instance(a, v, quotient_edges(inst.edge, cell_of).withColumnsRenamed({"a": "u", "b": "v"}))


def nested(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """cell, outer, one: whether each cell of fine lies in one cell of coarse (both atom_id, cell), and that cell if so."""
    both = fine.join(coarse.withColumnRenamed("cell", "outer"), "atom_id")
    lo, hi = F.min("outer"), F.max("outer")
    return both.groupBy("cell").agg(F.when(lo == hi, lo).alias("outer"), (lo == hi).alias("one"))


def refines(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """refines: whether each cell of fine lies in one cell of coarse (both atom_id, cell)."""
    one = nested(fine, coarse)
    return one.agg(F.coalesce(F.bool_and("one"), F.lit(True)).alias("refines"))


def refine(cells: DataFrame, nodes: DataFrame, chosen: DataFrame, depth: int = 1) -> DataFrame:
    """Cells (node_id) with the chosen ones replaced by descendants depth levels down; nodes: node_id, parent. Leaves stay."""
    kids = nodes.select(F.col("parent").alias("node_id"), F.col("node_id").alias("kid")).where("node_id is not null")
    kept = cells.join(chosen, "node_id", "left_anti").select("node_id")
    now = cells.join(chosen, "node_id", "left_semi").select("node_id")
    for _ in range(depth):
        now = now.join(kids, "node_id", "left").select(F.coalesce("kid", "node_id").alias("node_id"))
    return kept.unionByName(now)


def with_mass(inst: Instance, regime: Regime) -> DataFrame:
    """atom_id, contest, pop, mass: the safety mass of every atom in the regime's contests."""
    p, o = safety.party_votes(regime.party)
    v = inst.vote.where(F.col("contest").isin(*regime.contests)).select("atom_id", "contest", safety.safety_mass(p, o, regime.m).alias("mass"))
    return v.join(inst.atom.select("atom_id", "pop"), "atom_id")


def envelope_scalars(mass: DataFrame, cell_of: DataFrame) -> DataFrame:
    """cell, contest: population, least population, sums of mass (all, negative, positive; and those of unpopulated atoms)."""
    m, none = F.col("mass"), F.col("pop") == 0
    neg, pos = F.least(m, F.lit(0)), F.greatest(m, F.lit(0))
    if_ = lambda c: F.sum(F.when(none, c).otherwise(F.lit(0)))
    return mass.join(cell_of, "atom_id").groupBy("cell", "contest").agg(
        F.sum("pop").alias("pop"), F.min("pop").alias("pmin"), F.sum(m).alias("csum"), F.sum(neg).alias("cneg"), F.sum(pos).alias("cpos"),
        if_(neg).alias("zneg"), if_(pos).alias("zpos"))


def ranked(d: DataFrame, keys: list[str], by: Column, sums: dict[str, str], buckets: int | None = None) -> DataFrame:
    """d (keys..., atom_id) with its rank t in each group by rising `by`, nulls first and ties by atom_id, and the sums of columns before each row (name: column).

    No group is ranked in one task. Quantiles of its values cut it into buckets; rows whose value is itself a quantile,
    which may be many, lie apart and are cut by quantiles of their ids. The buckets' sums place them, and only rows of one
    bucket are ranked together. Quantiles are approximate and decide only how the work is dealt; they are written down,
    so that a task that runs again meets the same ones.
    """
    n = buckets or max(8, min(512, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = [i / n for i in range(1, n)]
    kept = d.columns
    d = d.withColumn("_r", by)
    quantiles = lambda c: F.coalesce(F.array_distinct(F.percentile_approx(c, at)), F.array().cast(f"array<{d.schema[c].dataType.simpleString()}>"))
    cuts = cut(d.groupBy(*keys).agg(quantiles("_r").alias("_rs"), quantiles("atom_id").alias("_ids")))
    below = lambda a, c: F.size(F.filter(a, lambda v: v < F.col(c)))
    hot = F.coalesce(F.array_contains("_rs", F.col("_r")), F.lit(False))
    place = F.struct(F.when(F.col("_r").isNull(), -1).otherwise(below("_rs", "_r")).alias("s"), hot.alias("hot"), F.when(hot, below("_ids", "atom_id")).otherwise(0).alias("i"))
    d = d.join(cuts, keys).withColumn("_b", place).drop("_rs", "_ids")
    parts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_t"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*keys, "_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("t", *sums)])
    inside = W.partitionBy(*keys, "_b").orderBy("_r", "atom_id")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", (F.row_number().over(inside) - 1).alias("t"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in sums.items()])
    return d.join(starts, [*keys, "_b"]).select(*kept, *[(F.col(f"_{c}") + F.col(c)).alias(c) for c in ("t", *sums)])


def _by_density(d: DataFrame, keys: list[str], upper: bool = True) -> DataFrame:
    density = F.col("mass") / F.col("pop")
    return ranked(d, keys, -density if upper else density, {"x": "pop", "v": "mass"})


def knapsack_prefix(mass: DataFrame, cell_of: DataFrame, upper: bool = True) -> DataFrame:
    """Populated atoms of each cell and contest in order of density, with rank and the sums before each (x, v)."""
    d = mass.where("pop > 0").join(cell_of, "atom_id").select("cell", "contest", "atom_id", "pop", "mass")
    return _by_density(d, ["cell", "contest"], upper)


def knapsack_tangents(mass: DataFrame, cell_of: DataFrame, upper: bool = True, points: int = 10) -> DataFrame:
    """cell, contest, t, a, b, r: tangents a * c - b * x <= r (>= below) of the envelope at quantiles of population."""
    key = ["cell", "contest"]
    p = knapsack_prefix(mass, cell_of, upper)
    z = envelope_scalars(mass, cell_of).select(*key, F.col("zpos" if upper else "zneg").alias("z"))
    sums = mass.where("pop > 0").join(cell_of, "atom_id").groupBy(*key).agg(F.sum("pop").alias("total"), (F.count("*") - 1).alias("last"))
    # Atom t is taken if it is first or last or the first to begin at or after a quantile i * total / (points - 1).
    row = F.struct("t", "pop", "mass", "x", "v")
    part = F.floor(F.col("x") * (points - 1) / F.col("total"))
    ends = p.join(sums, key).groupBy(*key, "last", part.alias("part")).agg(F.min_by(row, "t").alias("first"), F.max_by(row, "t").alias("end"))
    taken = F.when(F.col("end.t") == F.col("last"), F.array_distinct(F.array("first", "end"))).otherwise(F.array("first"))
    q = ends.select(*key, F.explode(taken).alias("p")).select(*key, "p.*").join(z, key)
    a, b = F.col("pop"), F.col("mass")
    return q.select(*key, "t", a.alias("a"), b.alias("b"), (a * (F.col("z") + F.col("v")) - b * F.col("x")).alias("r"))


def median_split(inst: Instance, cell_of: DataFrame) -> DataFrame:
    """atom_id, cell, side: each cell cut at half its weight along its principal axis (its sign made positive in x, then y).

    Weights are populations, 1 at least; ties in projection go by atom. The axis is the closed form for 2 x 2 moments.
    """
    d = inst.atom.join(cell_of, "atom_id").withColumn("w", F.greatest("pop", F.lit(1)).cast("double"))
    s = lambda c: F.sum(F.col("w") * c)
    x, y = F.col("x"), F.col("y")
    m = d.groupBy("cell").agg(F.sum("w").alias("sw"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"), F.count("*").alias("n"))
    m = m.select("cell", "n", "sw", (F.col("sx") / F.col("sw")).alias("mx"), (F.col("sy") / F.col("sw")).alias("my"),
                 (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")).alias("cxx"), (F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")).alias("cyy"),
                 (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")).alias("cxy"))
    half = (F.col("cxx") - F.col("cyy")) / 2
    top = half + F.sqrt(half * half + F.col("cxy") * F.col("cxy"))  # largest eigenvalue less cyy
    flat = F.abs("cxy") < 1e-9
    ax = F.when(flat, F.when(F.col("cxx") >= F.col("cyy"), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.abs(top))
    ay = F.when(flat, F.when(F.col("cxx") >= F.col("cyy"), F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.col("cxy") * F.signum(top))
    m = m.withColumn("ax", ax).withColumn("ay", ay)
    proj = F.round((x - F.col("mx")) * F.col("ax") + (y - F.col("my")) * F.col("ay"), 6)
    p = d.join(m, "cell").withColumn("proj", proj)
    p = ranked(p.select("cell", "atom_id", "w", "n", "sw", "proj"), ["cell"], F.col("proj"), {"before": "w"})
    p = p.withColumn("i", F.col("t") + 1).withColumn("cum", F.col("before") + F.col("w"))
    ends = p.where(F.col("cum") * 2 >= F.col("sw")).groupBy("cell").agg(F.least(F.greatest(F.min("i"), F.lit(1)), F.first("n") - 1).alias("cut"))
    return p.join(ends, "cell").select("atom_id", "cell", (F.col("i") > F.col("cut")).cast("int").alias("side"))


def bisected(inst: Instance, cell_of: DataFrame, levels: int, leaf: int = 1) -> DataFrame:
    """level, node, atom_id: a tree of median splits; node 2 n and 2 n + 1 below a node n of more than `leaf` atoms.

    cell_of (atom_id, cell) names the roots, with cells as numbers from 1; a level's nodes are split together, so a tree
    takes as many rounds as it has levels, whatever its number of nodes.
    """
    at = cell_of.select("atom_id", F.col("cell").cast("bigint").alias("cell"))
    out = at.select(F.lit(0).alias("level"), F.col("cell").alias("node"), "atom_id")
    for level in range(1, levels + 1):
        large = at.groupBy("cell").count().where(F.col("count") > leaf).select("cell")
        split = median_split(inst, at.join(large, "cell"))
        at = cut(split.select("atom_id", (F.col("cell") * 2 + F.col("side")).alias("cell")))
        out = out.unionByName(at.select(F.lit(level).alias("level"), F.col("cell").alias("node"), "atom_id"))
    return out


def geography_free(inst: Instance, regime_of, grid: DataFrame, k: int, eps: tuple[int, int]) -> DataFrame:
    """q, m_n, m_d, possible: whether q districts of margin m aren't excluded when geography is left out (one contest).

    q safe districts of population L..U take a population X with q L <= X <= q U and (k - q) L <= T - X <= (k - q) U; the
    most mass that X can hold is the fractional knapsack's envelope, which is concave, so its largest value over the
    range lies at the range's end nearest its peak.
    """
    party, contest = regime_of
    p, o = safety.party_votes(party)
    v = inst.vote.where(F.col("contest") == contest).select("atom_id", p.alias("p"), o.alias("o"))
    d = inst.atom.select("atom_id", "pop").join(v, "atom_id").join(F.broadcast(grid))
    mass = (F.col("m_d") - 2 * F.col("m_n")) * F.col("p") - (F.col("m_d") + 2 * F.col("m_n")) * F.col("o")
    d = d.withColumn("mass", mass)
    zero = d.groupBy("m_n", "m_d").agg(F.sum(F.when(F.col("pop") == 0, F.greatest("mass", F.lit(0))).otherwise(F.lit(0))).alias("z"), F.sum("pop").alias("total"))
    e = _by_density(d.where("pop > 0").select("m_n", "m_d", "atom_id", "pop", "mass"), ["m_n", "m_d"])
    lo, hi = safety.pop_window(F.col("total"), F.lit(k), eps)
    q = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("q")
    r = zero.withColumn("lo", lo).withColumn("hi", hi).select("*", q)
    r = r.withColumn("from", F.greatest(F.col("q") * F.col("lo"), F.col("total") - (k - F.col("q")) * F.col("hi")))
    r = r.withColumn("to", F.least(F.col("q") * F.col("hi"), F.col("total") - (k - F.col("q")) * F.col("lo")))
    # The best value on [from, to]: over each atom's piece of the envelope that meets the range.
    b = e.join(F.broadcast(r), ["m_n", "m_d"]).where((F.col("x") <= F.col("to")) & (F.col("x") + F.col("pop") >= F.col("from")) & (F.col("from") <= F.col("to")))
    at = lambda x: F.col("v") * F.col("pop") + F.col("mass") * (x - F.col("x")) + F.col("z") * F.col("pop")  # noqa: E731  times pop
    left, right = F.greatest("x", "from"), F.least(F.col("x") + F.col("pop"), F.col("to"))
    ok = b.groupBy("m_n", "m_d", "q").agg(F.bool_or((at(left) >= 0) | (at(right) >= 0)).alias("ok"))
    return r.join(ok, ["m_n", "m_d", "q"], "left").select("q", "m_n", "m_d", F.coalesce("ok", F.lit(False)).alias("possible"))


def geography_free_of_all(inst: Instance, party: str, contests: list[str], grid: DataFrame, k: int, eps: tuple[int, int]) -> DataFrame:
    """As geography_free for districts that are safe in every contest: a margin is excluded where any one contest excludes it, a bound that may be wider than one over all contests at once."""
    every = [geography_free(inst, (party, c), grid, k, eps) for c in contests]
    both = every[0]
    for one in every[1:]:
        both = both.unionByName(one)
    return both.groupBy("q", "m_n", "m_d").agg(F.bool_and("possible").alias("possible"))


def first_excluded(possible: DataFrame) -> DataFrame:
    """q and the least margin of the grid that geography_free excludes (null if none)."""
    m = F.struct("m_n", "m_d")
    got = possible.groupBy("q").agg(F.min_by(m, F.when(~F.col("possible"), F.col("m_n") / F.col("m_d"))).alias("m"))
    return got.select("q", F.when(F.col("m").isNotNull(), F.struct(F.col("m.m_n").cast("bigint").alias("n"), F.col("m.m_d").cast("bigint").alias("d"))).alias("m"))


def cell_plan(plans: DataFrame, cell_of: DataFrame) -> DataFrame:
    """plan, cell, split, district: whether a cell lies in several districts, and its one district otherwise."""
    c = plans.join(cell_of, "atom_id").groupBy("plan", "cell").agg(F.min("district").alias("lo"), F.max("district").alias("hi"))
    return c.select("plan", "cell", (F.col("lo") != F.col("hi")).alias("split"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("district"))


def hint(plans: DataFrame, cell_of: DataFrame) -> DataFrame:
    """plan, cell, district: the districts that each cell meets, a start for a solver over cells."""
    return plans.join(cell_of, "atom_id").select("plan", "cell", "district").distinct()
