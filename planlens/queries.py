"""Queries over the derived instances, with the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.functions import rational as R
from planlens.functions import safety
from planlens.model import Instance, Regime
from planlens.operators import brackets as B
from planlens.operators import cells as C
from planlens.operators import curves as K
from planlens.operators import decide as DC
from planlens.operators import districts as D
from planlens.operators import graphs as G
from planlens.operators import ingest as I
from planlens.operators import search as S
from planlens.plans import lower, reports, verify
from planlens.sources import fixtures as X
from planlens.sources import instances as IN
from planlens.sources import runs as RU

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Common tables of the SQL side.
NATION = """
atom AS (SELECT n_nationkey::INTEGER AS atom_id, n_regionkey::INTEGER AS county, coalesce(p.pop, 0)::BIGINT AS pop,
                (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y
         FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1) p ON p.c_nationkey = n_nationkey),
counted AS (SELECT c_nationkey::INTEGER AS atom_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS contest,
                   count(*) FILTER (o_orderstatus = 'F') AS d, count(*) FILTER (o_orderstatus = 'O') AS r
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
vote AS (SELECT a.atom_id, c.contest, coalesce(d, 0)::BIGINT AS d, coalesce(r, 0)::BIGINT AS r
         FROM atom a CROSS JOIN (VALUES ('A'), ('B')) c(contest) LEFT JOIN counted USING (atom_id, contest)),
edge AS (SELECT atom_id AS u, atom_id + 1 AS v FROM atom WHERE atom_id % 5 < 4 UNION ALL SELECT atom_id, atom_id + 5 FROM atom WHERE atom_id < 20),
plan AS (SELECT p.plan, p.k, atom_id, (CASE p.plan WHEN 'row' THEN atom_id // 5 WHEN 'col' THEN atom_id % 5 WHEN 'mod4' THEN atom_id % 4 ELSE 0 END)::INTEGER AS district
         FROM atom CROSS JOIN (VALUES ('row', 5), ('col', 5), ('mod4', 4), ('one', 5)) p(plan, k))"""
CUSTOMER = """
atom AS (SELECT c_custkey::INTEGER AS atom_id, c_nationkey::INTEGER AS county, 1::BIGINT AS pop, c_acctbal AS x, 0.0::DOUBLE AS y FROM customer),
counted AS (SELECT o_custkey::INTEGER AS atom_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS contest,
                   count(*) FILTER (o_orderstatus = 'F') AS d, count(*) FILTER (o_orderstatus = 'O') AS r FROM orders GROUP BY 1, 2),
vote AS (SELECT a.atom_id, c.contest, coalesce(d, 0)::BIGINT AS d, coalesce(r, 0)::BIGINT AS r
         FROM atom a CROSS JOIN (VALUES ('A'), ('B')) c(contest) LEFT JOIN counted USING (atom_id, contest)),
edge AS (SELECT u, v FROM (SELECT lag(atom_id) OVER (PARTITION BY county ORDER BY atom_id) AS u, atom_id AS v FROM atom) WHERE u IS NOT NULL),
plan AS (SELECT p.plan, p.k, atom_id, (CASE p.plan WHEN 'key5' THEN atom_id % 5 ELSE county % 5 END)::INTEGER AS district
         FROM atom CROSS JOIN (VALUES ('key5', 5), ('nation5', 5)) p(plan, k))"""
STATS = """
label AS (SELECT DISTINCT plan, k, unnest(range(0, k))::INTEGER AS district FROM plan),
dv AS (SELECT l.plan, l.k, l.district, c.contest, coalesce(sum(v.d), 0)::BIGINT AS p, coalesce(sum(v.r), 0)::BIGINT AS o
       FROM label l CROSS JOIN (SELECT DISTINCT contest FROM vote) c
       LEFT JOIN plan pl ON pl.plan = l.plan AND pl.district = l.district LEFT JOIN vote v ON v.atom_id = pl.atom_id AND v.contest = c.contest
       GROUP BY ALL),
margins AS (SELECT plan, k, district, min(CASE WHEN p + o > 0 THEN (p - o)::DOUBLE / (2 * (p + o)) ELSE -0.5 END) AS margin,
                   bool_and(p + o > 0 AND 100 * p - 100 * o >= 0) AS safe FROM dv GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS q, sum(margin) OVER (w ROWS UNBOUNDED PRECEDING) AS top_sum
           FROM margins WINDOW w AS (PARTITION BY plan ORDER BY margin DESC, district))"""
FACT = """
fact AS (SELECT 't' || (o_orderkey % 7) AS tag, 'S' || (o_custkey // 5 % 40) AS state, CASE WHEN o_orderkey // 64 % 2 = 0 THEN 'D' ELSE 'R' END AS party,
                (o_orderkey // 4 % 4 + 1)::INTEGER AS cap, ['1/200', '1/100', '1/50'][o_orderkey // 16 % 3 + 1] AS eps, (o_custkey % 5 + 1)::INTEGER AS q,
                CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE 'feasible' END AS regime, floor(o_totalprice)::BIGINT AS seconds,
                CASE WHEN o_orderkey % 3 = 0 THEN base - o_orderkey % 29 END AS lo,
                CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 101 = 0 THEN base - 20 ELSE base + 1 + o_orderkey % 31 END END AS hi
         FROM (SELECT *, o_custkey // 5 % 40 * 7 % 160 - 60 - 8 * (o_custkey % 5 + 1) AS base FROM orders)),
best AS (SELECT state, party, cap, eps, q, max(lo) AS lo, min(hi) AS hi FROM fact WHERE regime = 'feasible' GROUP BY ALL),
merged AS (SELECT b.*, s.seconds::BIGINT AS seconds, NOT coalesce(hi IS NOT NULL AND CASE WHEN lo IS NULL THEN hi <= 0 ELSE hi - lo <= 2 END, false) AS unknown
           FROM best b JOIN (SELECT state, party, cap, eps, sum(seconds) AS seconds FROM fact GROUP BY ALL) s USING (state, party, cap, eps))"""
BOUNDS = """
bounds AS (SELECT state, party, cap, eps, m_n, m_d, coalesce(max(CASE WHEN lo * m_d >= m_n * 400 THEN q END), 0)::INTEGER AS f_lo,
                  coalesce(max(CASE WHEN hi IS NULL OR m_n * 400 < hi * m_d THEN q END), 0)::INTEGER AS f_hi
           FROM merged CROSS JOIN (VALUES (0, 1), (1, 20), (1, 10)) g(m_n, m_d) GROUP BY ALL)"""
GRID = [(0, 1), (1, 20), (1, 10)]
FINE = [(i, 100) for i in range(-10, 11)]
BOTH = Regime("D", (0, 1), (1, 5), X.CONTESTS, None)
ONE = Regime("D", (1, 20), (1, 5), ("A",), None)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def grid(spark: SparkSession, rows=GRID) -> DataFrame:
    return spark.createDataFrame(rows, "m_n int, m_d int")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def _on(which: str):
    return (X.nation, X.nation_plans) if which == "nation" else (X.customer, X.customer_plans)


def both_instances(sql: str, name: str):
    """Registers f(instance, plans) for the nation and the customer instance; sql follows the common tables."""

    def add(f):
        for which, base in (("nation", NATION), ("customer", CUSTOMER)):
            inst, plans = _on(which)
            key = name if which == "nation" else f"{name}_customer"
            QUERIES[key] = lambda spark, d, inst=inst, plans=plans: f(inst(spark, d), plans(spark, d))
            ORACLE[key] = _with(base, STATS) + sql
        return f

    return add


# Projections and aggregates over plans

@query(_with(NATION) + "SELECT atom_id, contest, r AS p, d AS o FROM vote")
def party_votes_swap(spark, d):
    p, o = safety.party_votes("D")
    return D.swapped(X.nation(spark, d)).vote.select("atom_id", "contest", p.alias("p"), o.alias("o"))


@query(_with(NATION) + "SELECT atom_id, contest, (20 - 2) * d - (20 + 2) * r AS mass FROM vote")
def safety_coeffs(spark, d):
    p, o = safety.party_votes("D")
    return X.nation(spark, d).vote.select("atom_id", "contest", safety.safety_mass(p, o, (1, 20)).alias("mass"))


@query(_with(NATION) + """SELECT k, e AS eps, ((b - a) * t + b * k - 1)::BIGINT // (b * k) AS lo, ((b + a) * t)::BIGINT // (b * k) AS hi
FROM (SELECT sum(pop)::BIGINT AS t FROM atom) CROSS JOIN (VALUES (2), (3), (5), (7)) k(k) CROSS JOIN (VALUES ('1/5', 1, 5), ('1/100', 1, 100)) e(e, a, b)""")
def pop_window(spark, d):
    total = X.nation(spark, d).atom.agg(F.sum("pop").alias("t")).withColumn("k", F.explode(F.array(*map(F.lit, (2, 3, 5, 7)))))
    out = None
    for a, b in ((1, 5), (1, 100)):
        lo, hi = safety.pop_window(F.col("t"), F.col("k"), (a, b))
        one = total.select("k", F.lit(f"{a}/{b}").alias("eps"), lo.alias("lo"), hi.alias("hi"))
        out = one if out is None else out.unionByName(one)
    return out


@both_instances("""SELECT l.plan, l.k, l.district, count(a.atom_id) AS atoms, coalesce(sum(a.pop), 0)::BIGINT AS pop
FROM label l LEFT JOIN plan p ON p.plan = l.plan AND p.district = l.district LEFT JOIN atom a ON a.atom_id = p.atom_id GROUP BY ALL""", "district_pop")
def _(inst, plans):
    return D.district_pop(inst, plans)


@both_instances("SELECT plan, k, district, contest, p, o FROM dv", "district_votes")
def _(inst, plans):
    return D.district_votes(inst, plans)


@both_instances("SELECT plan, k, district, margin, safe FROM margins", "robust_margin")
def _(inst, plans):
    return D.robust_margins(inst, plans, BOTH)


@both_instances("SELECT plan, q::INTEGER AS q, district, margin FROM ranked", "qth_margin")
def _(inst, plans):
    return D.ranked(D.robust_margins(inst, plans, BOTH)).select("plan", "q", "district", "margin")


@both_instances("SELECT plan, q::INTEGER AS q, round(top_sum, 9) AS top_sum FROM ranked", "topq_margin_sum")
def _(inst, plans):
    return D.ranked(D.robust_margins(inst, plans, BOTH)).select("plan", "q", F.round("top_sum", 9).alias("top_sum"))


@both_instances("SELECT plan, count(*) FILTER (safe) AS safe FROM margins GROUP BY plan", "safe_count")
def _(inst, plans):
    return D.safe_count(D.robust_margins(inst, plans, BOTH))


@both_instances("""SELECT plan, m_n, m_d, count(*) FILTER (margin >= m_n::DOUBLE / m_d) AS seats FROM margins
CROSS JOIN (SELECT unnest(range(-10, 11))::INTEGER AS m_n, 100 AS m_d) GROUP BY ALL""", "frontier_staircase")
def _(inst, plans):
    return D.frontier(D.robust_margins(inst, plans, BOTH), grid(inst.atom.sparkSession, FINE))


@both_instances("SELECT k, q::INTEGER AS q, max(margin) AS sigma FROM ranked GROUP BY ALL", "best_over_plans")
def _(inst, plans):
    return D.best_over_plans(D.robust_margins(inst, plans, BOTH))


@both_instances("SELECT plan, round(sum(greatest(margin, 0)), 9) AS area FROM margins GROUP BY plan", "layer_cake")
def _(inst, plans):
    return D.layer_cake(D.robust_margins(inst, plans, BOTH)).select("plan", F.round("area", 9).alias("area"))


@both_instances("""SELECT plan, sum(n - 1)::BIGINT AS splits FROM (SELECT plan, county, count(DISTINCT district) AS n FROM plan JOIN atom USING (atom_id) GROUP BY ALL) GROUP BY plan""", "county_splits")
def _(inst, plans):
    return D.county_splits(inst, plans)


@both_instances("""SELECT plan, round(max(abs(pop * k / total - 1)), 9) AS deviation FROM (
  SELECT plan, k, district, sum(pop)::DOUBLE AS pop, sum(sum(pop)) OVER (PARTITION BY plan)::DOUBLE AS total FROM plan JOIN atom USING (atom_id) GROUP BY plan, k, district) GROUP BY plan""", "max_pop_deviation")
def _(inst, plans):
    return D.max_pop_deviation(inst, plans).select("plan", F.round("deviation", 9).alias("deviation"))


@both_instances("""SELECT a.plan, least(a.district, b.district) AS a, greatest(a.district, b.district) AS b, count(*) AS edges
FROM edge JOIN plan a ON a.atom_id = u JOIN plan b ON b.atom_id = v AND b.plan = a.plan WHERE a.district <> b.district GROUP BY ALL""", "cut_edges")
def _(inst, plans):
    return D.cut_edges(inst, plans)


@both_instances("""SELECT DISTINCT a.plan, least(a.district, b.district) AS a, greatest(a.district, b.district) AS b
FROM edge JOIN plan a ON a.atom_id = u JOIN plan b ON b.atom_id = v AND b.plan = a.plan WHERE a.district <> b.district""", "district_adjacency")
def _(inst, plans):
    return D.cut_edges(inst, plans).select("plan", "a", "b")


@both_instances("""SELECT DISTINCT plan, county FROM (
  SELECT a.plan, unnest([x.county, y.county]) AS county FROM edge JOIN plan a ON a.atom_id = u JOIN plan b ON b.atom_id = v AND b.plan = a.plan
    JOIN atom x ON x.atom_id = u JOIN atom y ON y.atom_id = v WHERE a.district <> b.district AND x.county <> y.county
  UNION ALL SELECT plan, county FROM plan JOIN atom USING (atom_id) GROUP BY ALL HAVING count(DISTINCT district) > 1)""", "boundary_counties")
def _(inst, plans):
    return D.boundary_counties(inst, plans)


@both_instances("SELECT plan, county FROM plan JOIN atom USING (atom_id) GROUP BY ALL HAVING count(DISTINCT district) = 1", "free_counties")
def _(inst, plans):
    return D.free_counties(inst, plans)


@both_instances("SELECT p.plan, p.k, p.atom_id, (r.q - 1)::INTEGER AS district FROM plan p JOIN ranked r ON r.plan = p.plan AND r.district = p.district", "relabel_by_margin")
def _(inst, plans):
    return D.relabelled(plans, D.robust_margins(inst, plans, BOTH))


@both_instances("SELECT plan, district, min(atom_id) AS root FROM plan GROUP BY ALL", "first_used_atom")
def _(inst, plans):
    return D.first_used_atom(plans)


COMPONENTS = """
nb AS (SELECT p.plan, p.atom_id AS a, q.atom_id AS b FROM (SELECT u, v FROM edge UNION ALL SELECT v, u FROM edge) e
       JOIN plan p ON p.atom_id = e.u JOIN plan q ON q.atom_id = e.v AND q.plan = p.plan AND q.district = p.district),
reach AS (SELECT plan, atom_id AS a, atom_id AS b FROM plan UNION SELECT r.plan, r.a, n.b FROM reach r JOIN nb n ON n.plan = r.plan AND n.a = r.b),
parts AS (SELECT plan, district, count(DISTINCT label) AS parts FROM (SELECT plan, a AS atom_id, min(b) AS label FROM reach GROUP BY ALL) JOIN plan USING (plan, atom_id) GROUP BY ALL)"""


@query("WITH RECURSIVE " + ",".join((NATION, COMPONENTS)) + " SELECT plan, district, parts FROM parts")
def components_per_district(spark, d):
    return G.district_components(X.nation(spark, d), X.nation_plans(spark, d))


@query(_with(CUSTOMER) + """SELECT county, count(*) AS atoms, min(atom_id) AS label FROM atom GROUP BY county""")
def county_components(spark, d):
    return G.county_components(X.customer(spark, d)).groupBy("county").agg(F.count("*").alias("atoms"), F.max("label").alias("label"))


@query("WITH RECURSIVE " + ",".join((NATION, STATS, COMPONENTS)) + """,
t AS (SELECT sum(pop)::BIGINT AS total FROM atom),
pops AS (SELECT l.plan, l.k, l.district, count(a.atom_id) AS atoms, coalesce(sum(a.pop), 0)::BIGINT AS pop FROM label l
         LEFT JOIN plan p ON p.plan = l.plan AND p.district = l.district LEFT JOIN atom a ON a.atom_id = p.atom_id GROUP BY ALL),
e AS (SELECT p.plan, p.k, p.district, m.safe, m.margin, CASE WHEN atoms = 0 THEN ['district ' || p.district || ' empty'] ELSE [] END ||
      CASE WHEN atoms > 0 AND NOT pop BETWEEN (4 * total + 5 * p.k - 1) // (5 * p.k) AND 6 * total // (5 * p.k) THEN ['district ' || p.district || ' population'] ELSE [] END ||
      CASE WHEN coalesce(c.parts, 1) > 1 THEN ['district ' || p.district || ' not connected'] ELSE [] END AS errors
      FROM pops p CROSS JOIN t JOIN margins m USING (plan, district) LEFT JOIN parts c USING (plan, district)),
s AS (SELECT plan, sum(n - 1)::BIGINT AS splits FROM (SELECT plan, county, count(DISTINCT district) AS n FROM plan JOIN atom USING (atom_id) GROUP BY ALL) GROUP BY plan)
SELECT e.plan, e.k, sum(len(errors)) = 0 AS valid, count(*) FILTER (safe) AS safe, any_value(splits) AS splits,
       array_to_string(flatten(list(errors ORDER BY district)), '; ') AS errors, max(margin) AS best, min(margin) AS worst
FROM e JOIN s USING (plan) GROUP BY ALL""")
def verify_plan(spark, d):
    v = verify.verify(X.nation(spark, d), X.nation_plans(spark, d), BOTH)
    return v.select("plan", "k", "valid", "safe", "splits", F.array_join("errors", "; ").alias("errors"), F.array_max("margins").alias("best"), F.array_min("margins").alias("worst"))


# Cells

CELLS = "cell_of AS (SELECT atom_id, (county * 100 + atom_id % 3)::INTEGER AS cell FROM atom)"


def _cells(inst: Instance, per: int = 3) -> DataFrame:
    return inst.atom.select("atom_id", (F.col("county") * 100 + F.col("atom_id") % per).cast("int").alias("cell"))


@query(_with(CUSTOMER, CELLS) + "SELECT DISTINCT least(a.cell, b.cell) AS a, greatest(a.cell, b.cell) AS b FROM edge JOIN cell_of a ON a.atom_id = u JOIN cell_of b ON b.atom_id = v WHERE a.cell <> b.cell")
def quotient_edges(spark, d):
    i = X.customer(spark, d)
    return C.quotient_edges(i.edge, _cells(i))


@query(_with(NATION) + "SELECT DISTINCT least(a.county, b.county) AS a, greatest(a.county, b.county) AS b FROM edge JOIN atom a ON a.atom_id = u JOIN atom b ON b.atom_id = v WHERE a.county <> b.county")
def county_adjacency(spark, d):
    return D.county_adjacency(X.nation(spark, d))


@query(_with(CUSTOMER, CELLS) + """SELECT c.cell AS atom_id, min(county) AS county, sum(pop)::BIGINT AS pop, round(sum(x * greatest(pop, 1)) / sum(greatest(pop, 1)), 6) AS x, v.d, v.r
FROM atom JOIN cell_of c USING (atom_id) JOIN (SELECT cell, sum(d)::BIGINT AS d, sum(r)::BIGINT AS r FROM vote JOIN cell_of USING (atom_id) GROUP BY cell) v ON v.cell = c.cell GROUP BY ALL""")
def coarsen_cells(spark, d):
    i = X.customer(spark, d)
    c = C.coarsen(i, _cells(i))
    v = c.vote.groupBy("atom_id").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    return c.atom.join(v, "atom_id").select("atom_id", "county", "pop", F.round("x", 6).alias("x"), "d", "r")


MASS = "mass AS (SELECT v.atom_id, contest, pop, 18 * d - 22 * r AS mass FROM vote v JOIN atom USING (atom_id) WHERE contest = 'A')"


@query(_with(CUSTOMER, CELLS, MASS) + """SELECT cell, contest, sum(pop)::BIGINT AS pop, min(pop) AS pmin, sum(mass)::BIGINT AS csum, sum(least(mass, 0))::BIGINT AS cneg, sum(greatest(mass, 0))::BIGINT AS cpos,
  coalesce(sum(least(mass, 0)) FILTER (pop = 0), 0)::BIGINT AS zneg, coalesce(sum(greatest(mass, 0)) FILTER (pop = 0), 0)::BIGINT AS zpos FROM mass JOIN cell_of USING (atom_id) GROUP BY ALL""")
def envelope_scalars(spark, d):
    i = X.customer(spark, d)
    return C.envelope_scalars(C.with_mass(i, ONE), _cells(i))


PREFIX = """prefix AS (SELECT cell, contest, atom_id, pop, mass, row_number() OVER w - 1 AS t, coalesce(sum(pop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x,
  coalesce(sum(mass) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS v FROM mass JOIN cell_of USING (atom_id) WHERE pop > 0
  WINDOW w AS (PARTITION BY cell, contest ORDER BY mass::DOUBLE / pop DESC, atom_id))"""


@query(_with(CUSTOMER, CELLS, MASS, PREFIX) + "SELECT cell, contest, atom_id, pop, mass, t::INTEGER AS t, x, v FROM prefix")
def knapsack_prefix(spark, d):
    i = X.customer(spark, d)
    return C.knapsack_prefix(C.with_mass(i, ONE), _cells(i)).withColumn("t", F.col("t").cast("int"))


@query(_with(CUSTOMER, CELLS, MASS, PREFIX) + """, s AS (SELECT p.*, sum(pop) OVER g AS total, max(t) OVER g AS last, lag(x) OVER (PARTITION BY cell, contest ORDER BY t) AS prev FROM prefix p WINDOW g AS (PARTITION BY cell, contest)),
z AS (SELECT cell, contest, coalesce(sum(greatest(mass, 0)) FILTER (pop = 0), 0) AS z FROM mass JOIN cell_of USING (atom_id) GROUP BY ALL)
SELECT cell, contest, t::INTEGER AS t, pop AS a, mass AS b, (pop * (z + v) - mass * x)::BIGINT AS r FROM s JOIN z USING (cell, contest)
WHERE t = 0 OR t = last OR (x * 9)::BIGINT // total::BIGINT > (prev * 9)::BIGINT // total::BIGINT""")
def knapsack_tangents(spark, d):
    i = X.customer(spark, d)
    return C.knapsack_tangents(C.with_mass(i, ONE), _cells(i)).withColumn("t", F.col("t").cast("int"))


@query(_with(NATION) + """, g AS (SELECT unnest(range(-10, 11)) AS m_n, 100 AS m_d), m AS (SELECT m_n, m_d, atom_id, pop, (m_d - 2 * m_n) * d - (m_d + 2 * m_n) * r AS mass FROM atom JOIN vote USING (atom_id) CROSS JOIN g WHERE contest = 'A'),
t AS (SELECT m_n, m_d, sum(pop)::BIGINT AS total, coalesce(sum(greatest(mass, 0)) FILTER (pop = 0), 0)::BIGINT AS z FROM m GROUP BY ALL),
e AS (SELECT m_n, m_d, pop, mass, coalesce(sum(pop) OVER w, 0)::BIGINT AS x, coalesce(sum(mass) OVER w, 0)::BIGINT AS v FROM m WHERE pop > 0
      WINDOW w AS (PARTITION BY m_n, m_d ORDER BY mass::DOUBLE / pop DESC, atom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT t.*, q, (4 * total + 24) // 25 AS lo, 6 * total // 25 AS hi FROM t CROSS JOIN (SELECT unnest(range(1, 6)) AS q)),
b AS (SELECT *, greatest(q * lo, total - (5 - q) * hi) AS f, least(q * hi, total - (5 - q) * lo) AS u FROM r),
h AS (SELECT b.m_n, b.m_d, b.q, bool_or(v * pop + mass * (greatest(x, f) - x) + z * pop >= 0 OR v * pop + mass * (least(x + pop, u) - x) + z * pop >= 0) AS ok
      FROM b JOIN e USING (m_n, m_d) WHERE x <= u AND x + pop >= f AND f <= u GROUP BY ALL)
SELECT q::INTEGER AS q, b.m_n::INTEGER AS m_n, b.m_d::INTEGER AS m_d, coalesce(ok, false) AS possible FROM b LEFT JOIN h USING (m_n, m_d, q)""")
def geofree_bound(spark, d):
    return C.geography_free(X.nation(spark, d), ("D", "A"), grid(spark, FINE), 5, (1, 5))


@query("SELECT true AS fine_in_coarse, false AS coarse_in_fine")
def refines_check(spark, d):
    i = X.customer(spark, d)
    fine, coarse = _cells(i), i.atom.select("atom_id", F.col("county").alias("cell"))
    return C.refines(fine, coarse).withColumnRenamed("refines", "fine_in_coarse").join(C.refines(coarse, fine).withColumnRenamed("refines", "coarse_in_fine"))


NODES = "node AS (SELECT DISTINCT 100000 + n_regionkey AS node_id, NULL::INTEGER AS parent FROM nation UNION ALL SELECT 1000 + n_nationkey, 100000 + n_regionkey FROM nation UNION ALL SELECT 2000 + n_nationkey, 1000 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0)"


def _nodes(spark, d):
    n = X.read(spark, d, "nation")
    key, reg = F.col("n_nationkey"), F.col("n_regionkey")
    none = F.lit(None).cast("int").alias("parent")
    return n.select((reg + 100_000).alias("node_id"), none).distinct().unionByName(n.select((key + 1000).alias("node_id"), (reg + 100_000).alias("parent"))).unionByName(
        n.where(key % 2 == 0).select((key + 2000).alias("node_id"), (key + 1000).alias("parent")))


@query(_with(NODES) + """SELECT node_id FROM node WHERE parent IS NULL AND node_id % 2 = 1
UNION ALL SELECT coalesce(b.node_id, a.node_id) FROM node a LEFT JOIN node b ON b.parent = a.node_id WHERE a.parent >= 100000 AND a.parent % 2 = 0""")
def refine_cells(spark, d):
    nodes = _nodes(spark, d)
    roots = nodes.where("parent is null").select("node_id")
    return C.refine(roots, nodes, roots.where("node_id % 2 = 0"), 2)


@query(_with(CUSTOMER) + """, w AS (SELECT atom_id, county AS cell, greatest(pop, 1)::DOUBLE AS w, x, y FROM atom),
m AS (SELECT cell, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx FROM w GROUP BY cell),
o AS (SELECT w.*, m.n, m.sw, row_number() OVER (PARTITION BY cell ORDER BY round(x - mx, 6), atom_id) AS i, sum(w.w) OVER (PARTITION BY cell ORDER BY round(x - mx, 6), atom_id ROWS UNBOUNDED PRECEDING) AS cum FROM w JOIN m USING (cell)),
c AS (SELECT cell, least(greatest(min(i), 1), any_value(n) - 1) AS cut FROM o WHERE cum * 2 >= sw GROUP BY cell)
SELECT atom_id, cell, (i > cut)::INTEGER AS side FROM o JOIN c USING (cell)""")
def median_split(spark, d):
    i = X.customer(spark, d)
    return C.median_split(i, i.atom.select("atom_id", F.col("county").alias("cell")))


# Brackets and reports

def _merged(spark, d):
    return B.merge(X.bracket_facts(spark, d))


def _n(c: str):
    """A fraction over 400 as its numerator."""
    return F.col(f"{c}.n").alias(c)


@query(_with(FACT) + "SELECT state, party, cap, eps, q, lo, hi, unknown, seconds FROM merged")
def bracket_merge(spark, d):
    return _merged(spark, d).select(*B.KEY, "q", _n("lo"), _n("hi"), "unknown", "seconds")


@query(_with(FACT) + "SELECT state, party, cap, eps, q, lo, hi FROM merged WHERE lo >= hi")
def consistency_check(spark, d):
    return B.violations(X.bracket_facts(spark, d)).select(*B.KEY, "q", _n("lo"), _n("hi"))


@query(_with(FACT, BOUNDS) + "SELECT state, party, cap, eps, m_n, m_d, f_lo, f_hi FROM bounds")
def frontier_bounds(spark, d):
    return B.frontier_bounds(_merged(spark, d), grid(spark))


WIDTH = "CASE WHEN lo IS NULL AND hi <= 0 THEN 0 WHEN lo IS NULL OR hi IS NULL THEN 'infinity'::DOUBLE ELSE 100.0::DOUBLE * (hi - lo) * 400 / 160000 END"


@query(_with(FACT) + f""", w AS (SELECT cap, {WIDTH} AS w FROM merged) SELECT cap, count(*) AS brackets, count(*) FILTER (w <= 0.5) AS le_half, count(*) FILTER (w <= 1) AS le_1,
count(*) FILTER (w <= 2) AS le_2, count(*) FILTER (w <= 3) AS le_3, median(w) FILTER (w < 'infinity'::DOUBLE) AS median_width FROM w GROUP BY cap""")
def bracket_width_stats(spark, d):
    return B.tightness(_merged(spark, d), ["cap"])


@query(_with(FACT) + """SELECT state, party, cap, eps, q, max(lo) OVER (w ROWS UNBOUNDED PRECEDING) AS lo_c, min(hi) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_c
FROM merged WINDOW w AS (PARTITION BY state, party, eps, q ORDER BY cap)""")
def budget_closure(spark, d):
    return B.budget_closure(_merged(spark, d)).select(*B.KEY, "q", _n("lo_c"), _n("hi_c"))


EPS_ORDER = "CASE eps WHEN '1/200' THEN 1 WHEN '1/100' THEN 2 ELSE 3 END"


@query(_with(FACT) + f"""SELECT state, party, cap, eps, q, max(lo) OVER (w ROWS UNBOUNDED PRECEDING) AS lo_c, min(hi) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_c
FROM merged WINDOW w AS (PARTITION BY state, party, cap, q ORDER BY {EPS_ORDER})""")
def eps_closure(spark, d):
    return B.eps_closure(_merged(spark, d)).select(*B.KEY, "q", _n("lo_c"), _n("hi_c"))


@query(_with(FACT) + "SELECT state, party, cap, eps, q, min(hi) OVER (PARTITION BY state, party, cap, eps ORDER BY q ROWS UNBOUNDED PRECEDING) AS hi_prev FROM merged")
def hi_propagation(spark, d):
    return B.propagated(_merged(spark, d)).select(*B.KEY, "q", _n("hi_prev"))


MONO = """mono AS (SELECT *, last_value(lo IGNORE NULLS) OVER (PARTITION BY state, party, cap, eps ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM merged),
broken AS (SELECT state, party, cap, eps, q, 'order' AS rule FROM mono WHERE lo >= hi UNION ALL SELECT state, party, cap, eps, q, 'monotone' FROM mono WHERE prev < lo)"""


@query(_with(FACT, MONO) + "SELECT * FROM broken")
def monotone_q_check(spark, d):
    return B.monotone_errors(_merged(spark, d))


@query(_with(FACT) + "SELECT state, party, cap, eps, q FROM merged WHERE coalesce(hi - lo > 8, true) AND NOT coalesce(lo IS NULL AND hi <= 0, false)")
def unresolved_brackets(spark, d):
    return B.unresolved(_merged(spark, d), (1, 50)).select(*B.KEY, "q")


ZERO = "z AS (SELECT * FROM bounds WHERE cap = 1 AND eps = '1/100' AND m_n = 0)"


def _zero(spark, d):
    return B.frontier_bounds(_merged(spark, d), grid(spark)).where("cap = 1 and eps = '1/100' and m_n = 0")


@query(_with(FACT, BOUNDS, ZERO) + """SELECT a.state, 5 AS k, 5 - r.f_lo AS ver_min, a.f_lo AS ver_max, 5 - r.f_hi AS lim_min, a.f_hi AS lim_max
FROM z a JOIN z r ON a.state = r.state AND a.party = 'D' AND r.party = 'R'""")
def seat_range(spark, d):
    seats = X.bracket_facts(spark, d).select("state").distinct().withColumn("k", F.lit(5))
    return B.seat_ranges(_zero(spark, d), seats)


@query(_with(FACT, BOUNDS) + "SELECT m_n, m_d, sum(f_lo)::BIGINT AS f_lo, sum(f_hi)::BIGINT AS f_hi FROM bounds WHERE cap = 1 AND eps = '1/100' AND party = 'D' GROUP BY ALL")
def national_frontier(spark, d):
    return reports.national(B.frontier_bounds(_merged(spark, d), grid(spark)).where("cap = 1 and eps = '1/100' and party = 'D'"))


@query(_with(FACT, BOUNDS) + "SELECT state, party, cap, eps, m_n, m_d, CASE WHEN f_lo = f_hi THEN f_lo::VARCHAR ELSE f_lo || '--' || f_hi END AS seats FROM bounds")
def capacity_report(spark, d):
    return reports.capacity(_merged(spark, d), grid(spark))


@query(_with(FACT) + """SELECT state, party, cap, eps, q, CASE WHEN lo IS NULL AND hi <= 0 THEN '<50' WHEN lo IS NULL AND hi IS NULL THEN '--' WHEN lo IS NULL THEN '<' || printf('%.1f', 50 + hi / 4)
ELSE printf('%.2f', 50 + lo / 4) || '--' || CASE WHEN hi IS NULL THEN 'inf' ELSE printf('%.1f', 50 + round_even(hi / 4, 1)) END END AS bracket,
NOT coalesce((hi - lo) * 4000000 <= 51 * 160000, coalesce(lo IS NULL AND hi <= 0, false)) AS wide FROM (SELECT * FROM merged WHERE (hi IS NULL OR hi % 2 = 0))""")
def spectrum_report(spark, d):
    return reports.spectrum(_merged(spark, d).where("hi is null or hi.n % 2 = 0"))


@query(ORACLE["spectrum_report"].replace(" WHERE (hi IS NULL OR hi % 2 = 0)", ""))
def spectrum_report_all(spark, d):
    return reports.spectrum(_merged(spark, d))


@query(_with(FACT) + """, c AS (SELECT state, party, cap, eps, q, max(lo) OVER (w ROWS UNBOUNDED PRECEDING) AS lo_c, min(hi) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_c
  FROM merged WINDOW w AS (PARTITION BY state, party, eps, q ORDER BY cap)), f AS (SELECT state, party, q, max(hi) AS bound FROM merged WHERE q > 1 GROUP BY ALL)
SELECT state, party, cap, eps, q, lo_c, least(hi_c, bound) AS hi_c FROM c LEFT JOIN f USING (state, party, q)""")
def budget_sweep(spark, d):
    m = _merged(spark, d)
    free = m.where("q > 1").groupBy("state", "party", "q").agg(B.best("hi", True).alias("bound"))
    return reports.budget_sweep(m, free).select(*B.KEY, "q", _n("lo_c"), _n("hi_c"))


@query(_with(FACT) + f""", r AS (SELECT state, party, cap, eps, q, lo - 10 AS robust_lo, CASE WHEN q % 2 = 0 THEN hi - 5 END AS robust_hi FROM merged),
c AS (SELECT state, party, cap, eps, q, hi, max(lo) OVER (w ROWS UNBOUNDED PRECEDING) AS lo_c, min(hi) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_c
  FROM merged WINDOW w AS (PARTITION BY state, party, cap, q ORDER BY {EPS_ORDER}))
SELECT c.state, c.party, c.cap, c.eps, c.q, lo_c, hi_c, robust_lo, least(robust_hi, hi) AS robust_hi FROM c JOIN r USING (state, party, cap, eps, q)""")
def tolerance_report(spark, d):
    m = _merged(spark, d)
    down = lambda c, by: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.n") - by).alias("n"), F.col(f"{c}.d").alias("d")))
    robust = m.select(*B.KEY, "q", down("lo", 10).alias("lo"), F.when(F.col("q") % 2 == 0, down("hi", 5)).alias("hi"))
    return reports.tolerance(m, robust).select(*B.KEY, "q", *map(_n, ("lo_c", "hi_c", "robust_lo", "robust_hi")))


@query(_with(FACT) + """, m AS (SELECT * FROM merged WHERE cap = 1 AND eps = '1/100' AND lo IS NOT NULL), b AS (SELECT state, party, q, lo + 40 AS free, lo + 42 AS cells, lo + 41 AS refined, (lo - 3) / 400.0::DOUBLE AS search FROM m)
SELECT state, party, q, round(100 * ((free - hi) / 400.0::DOUBLE), 6) AS gained, round(100 / 400.0::DOUBLE, 6) AS cells_loss, CASE WHEN search >= 0 THEN round(100 * (lo / 400.0::DOUBLE - search), 6) END AS over_search FROM m JOIN b USING (state, party, q)""")
def ablation_report(spark, d):
    m = _merged(spark, d).where("cap = 1 and eps = '1/100' and lo is not null")
    up = lambda by: F.struct((F.col("lo.n") + by).alias("n"), F.col("lo.d").alias("d"))
    bounds = m.select("state", "party", "q", up(40).alias("free"), up(42).alias("cells"), up(41).alias("refined"), ((F.col("lo.n") - 3) / F.col("lo.d")).alias("search"))
    r = reports.ablation(m, bounds)
    return r.select("state", "party", "q", *[F.round(c, 6).alias(c) for c in ("gained", "cells_loss", "over_search")])


SHARES = "sm AS (SELECT state, party, ((hash % 41) - 20) / 100.0::DOUBLE AS margin FROM (SELECT DISTINCT state, party, substr(state, 2)::INTEGER * 7 + CASE party WHEN 'D' THEN 0 ELSE 13 END AS hash FROM merged))"


@query(_with(FACT, MONO, SHARES) + """, j AS (SELECT m.*, margin, lo / 400.0::DOUBLE AS l, hi / 400.0::DOUBLE AS h FROM merged m JOIN sm USING (state, party))
SELECT * FROM broken UNION ALL SELECT state, party, cap, eps, q, 'all districts above statewide' FROM j WHERE q = 5 AND l > margin
UNION ALL SELECT state, party, cap, eps, q, 'best district below statewide' FROM j WHERE q = 1 AND margin >= 0 AND h <= margin
UNION ALL SELECT state, party, cap, eps, q, 'all safe below half' FROM j WHERE q = 5 AND margin < 0 AND l >= 0""")
def sanity_report(spark, d):
    m = _merged(spark, d)
    h = F.substring("state", 2, 9).cast("int") * 7 + F.when(F.col("party") == "D", 0).otherwise(13)
    share = m.select("state", "party").distinct().select("state", "party", ((h % 41 - 20) / 100).alias("margin"))
    return reports.sanity(m, m.select("state").distinct().withColumn("k", F.lit(5)), share)


@query(_with(FACT, BOUNDS) + f""", w AS (SELECT {WIDTH} AS w FROM merged)
SELECT 'brackets' AS metric, count(*)::DOUBLE AS value FROM w UNION ALL SELECT 'tight', count(*) FILTER (w <= 0.5) FROM w UNION ALL SELECT 'median_width', median(w) FROM w
UNION ALL SELECT 'cases', count(*) FROM bounds UNION ALL SELECT 'exact', count(*) FILTER (f_lo = f_hi) FROM bounds""")
def headline_metrics(spark, d):
    m = _merged(spark, d)
    return B.headline(m, B.frontier_bounds(m, grid(spark)))


@query(_with(FACT) + """, s AS (SELECT state, party, q, (q * 7 % 50 - 20) / 400.0::DOUBLE AS margin FROM (SELECT DISTINCT state, party, q FROM merged))
SELECT state, party, cap, eps, q, coalesce(margin >= hi / 400.0::DOUBLE, false) AS refuted, coalesce(margin > lo / 400.0::DOUBLE, false) AS beaten FROM merged JOIN s USING (state, party, q)""")
def proof_vs_plan(spark, d):
    m = _merged(spark, d)
    s = m.select("state", "party", "q").distinct().withColumn("margin", (F.col("q") * 7 % 50 - 20) / 400)
    return B.against_plans(m, s).select(*B.KEY, "q", "refuted", "beaten")


RECORDS = """rec AS (SELECT 'S' || (o_custkey % 40) AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'R' END AS party, (o_custkey % 5 + 1)::INTEGER AS q, CASE o_orderstatus WHEN 'F' THEN 'infeasible' WHEN 'O' THEN 'feasible' ELSE 'unknown' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN 'heuristic' ELSE (o_custkey * 37 % 160) || '/400' END AS m FROM orders)"""


def _records(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "infeasible").when(F.col("o_orderstatus") == "O", "feasible").otherwise("unknown")
    m = F.when(key % 9 == 0, F.lit("heuristic")).otherwise(F.concat((cust * 37 % 160).cast("string"), F.lit("/400")))
    return X.read(spark, d, "orders").select(F.concat(F.lit("S"), (cust % 40).cast("string")).alias("state"), F.when(key % 2 == 0, F.lit("D")).otherwise(F.lit("R")).alias("party"),
                                             (cust % 5 + 1).cast("int").alias("q"), status.alias("status"), m.alias("m"),
                                             F.expr("cast(o_orderkey div 4 % 4 + 1 as int)").alias("cap"), F.expr("array('1/200', '1/100', '1/50')[o_orderkey div 16 % 3]").alias("eps"),
                                             F.expr("if(o_orderkey div 64 % 2 = 0, array('A'), array('A', 'B'))").alias("contests"))


@query(_with(RECORDS) + "SELECT state, party, q, min(split_part(m, '/', 1)::BIGINT) AS m FROM rec WHERE status = 'infeasible' AND m <> 'heuristic' GROUP BY ALL")
def tightest_proof(spark, d):
    return B.tightest_proof(_records(spark, d)).select("state", "party", "q", _n("m"))


@query(_with(RECORDS) + "SELECT count(*) FILTER (status = 'feasible') AS agree, count(*) FILTER (status = 'infeasible') AS disagree, count(*) FILTER (status = 'unknown') AS unknown, count(*) AS total FROM rec")
def audit_tallies(spark, d):
    verdict = F.when(F.col("status") == "feasible", "agree").when(F.col("status") == "infeasible", "disagree").otherwise("unknown")
    return B.tallies(_records(spark, d).select(verdict.alias("verdict")))


SOLVERS = """res AS (SELECT o_orderkey, unnest([{'solver': 'one', 'status': CASE WHEN o_orderkey % 3 = 0 THEN 'feasible' ELSE 'infeasible' END, 'seconds': floor(o_totalprice)},
  {'solver': 'two', 'status': CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'feasible' ELSE 'infeasible' END, 'seconds': floor(o_totalprice / 2)},
  {'solver': 'three', 'status': CASE WHEN o_orderkey % 50 = 0 THEN 'feasible' ELSE 'unknown' END, 'seconds': 1.0}]) AS a FROM orders),
flat AS (SELECT o_orderkey, a.solver AS solver, a.status AS status, a.seconds AS seconds FROM res),
cl AS (SELECT o_orderkey, bool_or(status = 'feasible') AND bool_or(status = 'infeasible') AS clash FROM flat GROUP BY 1)"""


@query(_with(SOLVERS) + """SELECT solver, count(*) FILTER (status <> 'unknown' AND seconds <= 100000) AS decided, median(seconds) FILTER (status <> 'unknown' AND seconds <= 100000) AS median_seconds,
count(*) FILTER (clash) AS contradictions FROM flat JOIN cl USING (o_orderkey) GROUP BY solver""")
def solver_scores(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    ans = lambda s, sec: F.struct(s.alias("status"), sec.cast("double").alias("seconds"))
    base = F.when(key % 3 == 0, "feasible").otherwise("infeasible")
    r = X.read(spark, d, "orders").select(ans(base, F.floor(price)).alias("one"), ans(F.when(key % 4 == 0, F.lit("unknown")).otherwise(base), F.floor(price / 2)).alias("two"),
                                          ans(F.when(key % 50 == 0, F.lit("feasible")).otherwise(F.lit("unknown")), F.lit(1.0)).alias("three"))
    return B.solver_scores(r, ["one", "two", "three"], 100_000.0)


# Ingest analogues: orders are blocks, customers are atoms

@query("""WITH b AS (SELECT o_custkey AS atom_id, ascii(o_orderstatus) * 10 + o_orderkey % 3 AS county, sum(floor(o_totalprice))::BIGINT AS pop FROM orders GROUP BY ALL)
SELECT atom_id, arg_min(county, (-pop, county))::BIGINT AS county FROM b GROUP BY atom_id""")
def plurality_county(spark, d):
    return I.plurality(_blocks(spark, d), "county")


def _blocks(spark, d):
    return X.read(spark, d, "orders").select(F.col("o_custkey").alias("atom_id"), (F.ascii("o_orderstatus") * 10 + F.col("o_orderkey") % 3).cast("bigint").alias("county"), F.floor("o_totalprice").cast("bigint").alias("pop"))


@query("SELECT count(*) AS straddling FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT ascii(o_orderstatus) * 10 + o_orderkey % 3) > 1)")
def straddle_count(spark, d):
    return I.straddling(_blocks(spark, d)).agg(F.count("*").alias("straddling"))


@query("""SELECT c_custkey AS atom_id, coalesce(sum(floor(o_totalprice)), 0)::BIGINT AS pop FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def atom_population(spark, d):
    atoms = X.read(spark, d, "customer").select(F.col("c_custkey").alias("atom_id"))
    return I.atom_population(atoms, _blocks(spark, d))


@query("SELECT true AS same")
def population_total_check(spark, d):
    atoms = X.read(spark, d, "customer").select(F.col("c_custkey").alias("atom_id"))
    return I.same_total(I.atom_population(atoms, _blocks(spark, d)), _blocks(spark, d))


@query("""WITH b AS (SELECT o_custkey, ascii(o_orderstatus) * 10 + o_orderkey % 3 AS county, sum(floor(o_totalprice)) AS pop FROM orders GROUP BY ALL)
SELECT sum(a - m)::BIGINT AS mass FROM (SELECT sum(pop) AS a, max(pop) AS m FROM b GROUP BY o_custkey)""")
def plan_argmax_population(spark, d):
    return I.off_plurality(_blocks(spark, d), "county")


@query("""WITH a AS (SELECT s_suppkey AS atom_id, s_acctbal AS x, s_nationkey AS county FROM supplier), c AS (SELECT * FROM a WHERE atom_id % 3 <> 0)
SELECT atom_id, county FROM c UNION ALL SELECT m.atom_id, CASE WHEN m.atom_id % 2 = 0 THEN m.county ELSE (SELECT arg_min(c.county, ((c.x - m.x) * (c.x - m.x), c.atom_id)) FROM c) END FROM a m WHERE m.atom_id % 3 = 0""")
def missing_atoms_fill(spark, d):
    s = X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("atom_id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.col("s_nationkey").alias("county"))
    covered = s.where("atom_id % 3 <> 0").select("atom_id", "county")
    atoms = s.withColumn("county", F.when(F.col("atom_id") % 2 == 0, F.col("county")))
    return I.filled(atoms, covered, 50.0)


@query("""WITH n AS (SELECT 'G20' || upper(substr(n_name, 1, 3)) || CASE WHEN n_nationkey % 3 = 0 THEN 'D' ELSE 'R' END || upper(substr(n_name, 2, 3)) AS name FROM nation
UNION ALL SELECT * FROM (VALUES ('G20PREDBID'), ('G20PRERTRU'), ('G20USSDABC'), ('G20USSRDEF'), ('G20USSRXYZ'), ('G20HALDABC'), ('G20HALRABC'), ('G20SSCDAAA'), ('G20SSCRAAA'), ('geometry'))),
x AS (SELECT name, regexp_extract(name, '^G20([A-Z]{3})([A-Z])([A-Za-z0-9]{3})$', 1) AS office, regexp_extract(name, '^G20([A-Z]{3})([A-Z])([A-Za-z0-9]{3})$', 2) AS party FROM n)
SELECT office, max(name) FILTER (party = 'D') AS d_column, max(name) FILTER (party = 'R') AS r_column FROM x
WHERE office <> '' AND office NOT LIKE 'H%' AND office NOT IN ('SBE', 'SSC', 'SAC', 'SCC', 'COU', 'UBR', 'PSC', 'DEL')
GROUP BY office HAVING count(*) FILTER (party = 'D') = 1 AND count(*) FILTER (party = 'R') = 1""")
def contest_parse(spark, d):
    part = lambda a, n: F.upper(F.substring("n_name", a, n))
    party = F.when(F.col("n_nationkey") % 3 == 0, F.lit("D")).otherwise(F.lit("R"))
    names = X.read(spark, d, "nation").select(F.concat(F.lit("G20"), part(1, 3), party, part(2, 3)).alias("name"))
    more = ["G20PREDBID", "G20PRERTRU", "G20USSDABC", "G20USSRDEF", "G20USSRXYZ", "G20HALDABC", "G20HALRABC", "G20SSCDAAA", "G20SSCRAAA", "geometry"]
    return I.contests(names.unionByName(spark.createDataFrame([(x,) for x in more], "name string")))


@query("SELECT c_custkey, lpad((c_nationkey % 7 * 13)::VARCHAR, 3, '0') AS county, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END, 0)::BIGINT AS votes FROM customer WHERE c_custkey % 4 <> 1")
def column_cleaning(spark, d):
    c = X.read(spark, d, "customer").withColumn("county", F.col("c_nationkey") % 7 * 13).withColumn("votes", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")))
    c = c.withColumn("district", F.when(F.col("c_custkey") % 4 == 1, F.lit("ZZ")).otherwise(F.lit("07")))
    return I.district_codes(c, "district").select("c_custkey", I.county_code("county").alias("county"), I.count_column("votes").alias("votes"))


@query("""WITH j AS (SELECT 'N' || n_nationkey AS state, p AS party, CASE c WHEN 'k-1' THEN n_nationkey % 4 + 1 WHEN 'k' THEN n_nationkey % 4 + 2 WHEN 'None' THEN NULL ELSE 3 END AS cap
FROM nation CROSS JOIN (VALUES ('D'), ('R')) p(p) CROSS JOIN (VALUES ('k-1'), ('k'), ('None'), ('3')) c(c))
SELECT state, party, cap::INTEGER AS cap FROM j WHERE NOT (state IN ('N1', 'N2', 'N3') AND party = 'D')""")
def job_resume_antijoin(spark, d):
    seats = X.read(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state"), (F.col("n_nationkey") % 4 + 2).alias("k"))
    done = spark.createDataFrame([("N1", "D"), ("N2", "D"), ("N3", "D"), ("N3", "D")], "state string, party string")
    return RU.remaining(RU.job_grid(seats, ["k-1", "k", "None", "3"]), done, ["state", "party"])


@query(_with(NATION) + """SELECT contest, 50 + 100 * ((sum(d) - sum(r))::DOUBLE / (2 * (sum(d) + sum(r)))) AS share, (sum(d) - sum(r))::DOUBLE / (2 * (sum(d) + sum(r))) AS margin,
(SELECT count(*) FROM atom) AS atoms, (SELECT count(DISTINCT county) FROM atom) AS counties, (SELECT sum(pop)::BIGINT FROM atom) AS total_pop, (SELECT count(*) FROM atom WHERE pop = 0) AS zero_pop, (SELECT count(*) FROM edge) AS edges FROM vote GROUP BY contest""")
def instance_summary(spark, d):
    return reports.instance_summary(X.nation(spark, d))


@query("WITH w AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer) SELECT c_nationkey, c_custkey, c_acctbal FROM w WHERE n = 1")
def keep_first(spark, d):
    return I.first_rows(X.read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], ["c_acctbal", "c_custkey"])


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 AND c_acctbal < 8000 THEN floor(c_acctbal / 2000)::BIGINT END AS poly_id FROM customer")
def points_in_polygons(spark, d):
    p = X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.5).alias("y"))
    return I.within(p, _strips(spark), 1000.0)


def _strips(spark):
    strip = lambda i: (i, [(2000.0 * i, 0.0), (2000.0 * (i + 1), 0.0), (2000.0 * (i + 1), 1.0), (2000.0 * i, 1.0)])
    return spark.createDataFrame([strip(i) for i in range(4)], "poly_id bigint, ring array<struct<x:double,y:double>>")


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, 2), (2, 3)) e(u, v)")
def polygon_adjacency(spark, d):
    return I.adjacency(_strips(spark), 0.001, 0.5)


@query("""WITH a AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS r_id, s_acctbal AS x FROM supplier WHERE s_suppkey % 2 = 1)
SELECT id, (SELECT arg_min(r_id, ((a.x - b.x) * (a.x - b.x), r_id)) FROM b) AS r_id FROM a""")
def nearest_points(spark, d):
    s = X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return I.nearest(s.where("id % 2 = 0"), s.where("id % 2 = 1").withColumnRenamed("id", "r_id"), 50.0, on="id")


# Search (rows only; the search is random or enumerates)

@query()
def search_plans(spark, d):
    i = X.nation(spark, d)
    found = S.search(i, Regime("D", (0, 1), (1, 5), ("A",), None), 5, 2, seeds=4, steps=60)
    checked = verify.verify(i, found.select("plan", "k", "atom_id", "district"), Regime("D", (0, 1), (1, 5), ("A",), None))
    return checked.select("plan", "valid", "safe", "splits")


@query()
def exact_spectrum(spark, d):
    i = X.nation(spark, d)
    return S.exact_spectra(i, 2, [Regime(p, (0, 1), (1, 20), ("A",), None) for p in "DR"])


@query()
def ward_cells(spark, d):
    return S.ward_nodes(X.nation(spark, d))


# Further rows of the inventory

@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 ORDER BY md5('17/' || c_custkey), c_custkey LIMIT 50")
def sample_rows(spark, d):
    pool = X.read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    return I.sample(pool, "c_custkey", 50, 17)


@query(_with(RECORDS) + """, r AS (SELECT *, row_number() OVER () AS nth FROM rec), f AS (SELECT state, party, q, m FROM rec WHERE status = 'infeasible' AND m <> 'heuristic' AND q <= 3 AND party = 'D')
SELECT DISTINCT state, party, q, m FROM f""")
def proof_keys(spark, d):
    r = _records(spark, d)
    return B.proof_keys(r.where("q <= 3 and party = 'D'")).select("state", "party", "q", "m").distinct()


PROOFS = RECORDS.replace(" AS m FROM orders)", """ AS m, (o_orderkey // 4 % 4 + 1)::INTEGER AS cap, ['1/200', '1/100', '1/50'][o_orderkey // 16 % 3 + 1] AS eps,
  CASE WHEN o_orderkey // 64 % 2 = 0 THEN ['A'] ELSE ['A', 'B'] END AS contests FROM orders)""")


@query(_with(PROOFS) + "SELECT DISTINCT state, party, q, m, cap, eps, contests FROM rec WHERE status = 'infeasible' AND m <> 'heuristic'")
def proof_keys_all(spark, d):
    return B.proof_keys(_records(spark, d))


@query(ORACLE["geofree_bound"].replace("SELECT q::INTEGER AS q, b.m_n::INTEGER AS m_n, b.m_d::INTEGER AS m_d, coalesce(ok, false) AS possible FROM b LEFT JOIN h USING (m_n, m_d, q)",
       "SELECT q::INTEGER AS q, min(b.m_n) FILTER (NOT coalesce(ok, false))::INTEGER AS m_n FROM b LEFT JOIN h USING (m_n, m_d, q) GROUP BY q"))
def geofree_sigma(spark, d):
    g = C.geography_free(X.nation(spark, d), ("D", "A"), grid(spark, FINE), 5, (1, 5))
    return C.first_excluded(g).select("q", F.col("m.n").cast("int").alias("m_n"))


@query(_with(NATION, STATS) + """, c AS (SELECT p.plan, a.county AS cell, count(DISTINCT district) AS n, min(district) AS district FROM plan p JOIN atom a USING (atom_id) GROUP BY ALL)
SELECT plan, cell, n > 1 AS split, CASE WHEN n = 1 THEN district END AS district FROM c""")
def split_cells(spark, d):
    i = X.nation(spark, d)
    return C.cell_plan(X.nation_plans(spark, d), i.atom.select("atom_id", F.col("county").alias("cell")))


@query(_with(NATION, STATS) + """SELECT DISTINCT p.plan, a.county AS cell, (r.q - 1)::INTEGER AS district FROM plan p JOIN atom a USING (atom_id) JOIN ranked r ON r.plan = p.plan AND r.district = p.district""")
def plan_hint(spark, d):
    i, plans = X.nation(spark, d), X.nation_plans(spark, d)
    return C.hint(D.relabelled(plans, D.robust_margins(i, plans, BOTH)), i.atom.select("atom_id", F.col("county").alias("cell")))


@both_instances("""SELECT plan, s::INTEGER AS swing, count(*) FILTER (margin + s / 100.0::DOUBLE >= 0) AS seats FROM margins CROSS JOIN (SELECT unnest(range(-20, 21)) AS s) GROUP BY ALL""", "seat_curve")
def _(inst, plans):
    return D.seat_curve(D.robust_margins(inst, plans, BOTH), range(-20, 21))


@query(_with(FACT, BOUNDS, ZERO) + """, s AS (SELECT a.state, 5 - r.f_lo AS ver_min, a.f_lo AS ver_max, 5 - r.f_hi AS lim_min, a.f_hi AS lim_max FROM z a JOIN z r ON a.state = r.state AND a.party = 'D' AND r.party = 'R')
SELECT sum(ver_min)::BIGINT AS ver_min, sum(ver_max)::BIGINT AS ver_max, sum(lim_min)::BIGINT AS lim_min, sum(lim_max)::BIGINT AS lim_max,
count(*) FILTER (ver_min = ver_max AND ver_max = lim_min AND lim_min = lim_max) AS forced, count(*) FILTER (2 * (5 - ver_min) > 5) AS other_majority, count(*) FILTER (2 * ver_max > 5) AS own_majority FROM s""")
def seat_range_totals(spark, d):
    seats = X.bracket_facts(spark, d).select("state").distinct().withColumn("k", F.lit(5))
    return B.range_totals(B.seat_ranges(_zero(spark, d), seats))


@query(_with(FACT) + """, e AS (SELECT state, party, q, 48 + (q * 3 + length(state)) % 9 AS share FROM (SELECT DISTINCT state, party, q FROM merged)),
g AS (SELECT m.q, 100 * (lo / 400.0::DOUBLE) + 50 - share AS gap FROM merged m JOIN e USING (state, party, q) WHERE cap = 1 AND eps = '1/100' AND lo > 0)
SELECT count(*) AS compared, count(*) FILTER (gap > 0) AS below, round(median(gap), 6) AS median_gap, round(median(gap) FILTER (q = 1), 6) AS median_gap_first FROM g""")
def enacted_gaps(spark, d):
    m = _merged(spark, d).where("cap = 1 and eps = '1/100'")
    e = m.select("state", "party", "q").distinct().withColumn("share", 48 + (F.col("q") * 3 + F.length("state")) % 9)
    g = B.enacted_gaps(m, e)
    return g.select("compared", "below", F.round("median_gap", 6).alias("median_gap"), F.round("median_gap_first", 6).alias("median_gap_first"))


@query(_with(NATION, STATS) + "SELECT plan, max(top_sum) FILTER (q = 2) AS top2, max(margin) FILTER (q = 2) AS second FROM ranked GROUP BY plan")
def search_objective(spark, d):
    r = D.ranked(D.robust_margins(X.nation(spark, d), X.nation_plans(spark, d), BOTH))
    return r.groupBy("plan").agg(F.max(F.when(F.col("q") == 2, F.col("top_sum"))).alias("top2"), F.max(F.when(F.col("q") == 2, F.col("margin"))).alias("second"))


@query(_with(FACT, BOUNDS) + """SELECT party || ' & ' || cap || ' & ' || n || ' \\\\' AS line FROM (SELECT party, cap, count(*) AS n FROM merged GROUP BY ALL)""")
def latex_lines(spark, d):
    return reports.latex_rows(_merged(spark, d).groupBy("party", "cap").agg(F.count("*").alias("n")))


@query()
def neighbourhood_search(spark, d):
    i = X.nation(spark, d)
    r = Regime("D", (0, 1), (1, 5), ("A",), None)
    start = S.best_of(S.search(i, r, 3, 1, seeds=2, steps=20))
    return S.improve(i, r, start, 3, 1, seeds=4, free=2).select("plan", "n", "d").distinct()


# Larger instances: the customers' chains are forests, so their parts are atoms less inner edges.

FOREST = """
inside AS (SELECT p.plan, p.district, count(*) AS n FROM edge e JOIN plan p ON p.atom_id = e.u JOIN plan q ON q.atom_id = e.v AND q.plan = p.plan AND q.district = p.district GROUP BY ALL),
parts AS (SELECT plan, district, (count(*) - coalesce(any_value(n), 0))::BIGINT AS parts FROM plan LEFT JOIN inside USING (plan, district) GROUP BY ALL)"""


def _customers(sql: str) -> str:
    """SQL over the nation instance and its parts, over the customer instance."""
    sql = sql.replace(NATION, CUSTOMER)
    a = sql.index("nb AS (SELECT")
    z = sql.index("parts AS (SELECT plan, district, count(DISTINCT label)")
    z = sql.index("GROUP BY ALL)", sql.index("USING (plan, atom_id)", z)) + len("GROUP BY ALL)")
    return sql[:a] + FOREST.strip() + sql[z:]


@query(_customers(ORACLE["components_per_district"]))
def components_per_district_customer(spark, d):
    return G.district_components(X.customer(spark, d), X.customer_plans(spark, d))


@query(_customers(ORACLE["verify_plan"]))
def verify_plan_customer(spark, d):
    v = verify.verify(X.customer(spark, d), X.customer_plans(spark, d), BOTH)
    return v.select("plan", "k", "valid", "safe", "splits", F.array_join("errors", "; ").alias("errors"), F.array_max("margins").alias("best"), F.array_min("margins").alias("worst"))


@query(ORACLE["geofree_bound"].replace(NATION, CUSTOMER))
def geofree_bound_customer(spark, d):
    return C.geography_free(X.customer(spark, d), ("D", "A"), grid(spark, FINE), 5, (1, 5)).select("q", "m_n", "m_d", "possible")


# Run documents and plan archives

@query(_with(FACT) + "SELECT cap, eps, lo, hi, unknown FROM merged WHERE state = 'S3' AND party = 'D' AND q = 2")
def bracket_lookup(spark, d):
    return reports.lookup(_merged(spark, d), "S3", "D", 2).select("cap", "eps", _n("lo"), _n("hi"), "unknown")


@query(_with(NATION) + "SELECT plan, substr(sha256(unhex(string_agg(printf('%02x00', district), '' ORDER BY atom_id))), 1, 16) AS plan_hash FROM plan GROUP BY plan")
def plan_hashes(spark, d):
    return IN.plan_hashes(X.nation_plans(spark, d))


@query(_with(NATION) + """, h AS (SELECT plan, substr(sha256(unhex(string_agg(printf('%02x00', district), '' ORDER BY atom_id))), 1, 16) AS plan_hash FROM plan GROUP BY plan)
SELECT plan_hash, plan, count(*) AS atoms, sum(district)::BIGINT AS labels FROM plan JOIN h USING (plan) WHERE plan IN ('row', 'mod4') GROUP BY ALL""")
def plan_archive(spark, d):
    plans = X.nation_plans(spark, d)
    wanted = IN.plan_hashes(plans.where("plan in ('row', 'mod4')")).select("plan_hash")
    return IN.from_archive(wanted, plans).groupBy("plan_hash", "plan").agg(F.count("*").alias("atoms"), F.sum("district").alias("labels"))


def _run_documents(spark, d):
    """The bracket facts as run documents: a map from q to JSON text."""
    f = X.bracket_facts(spark, d).groupBy("tag", "state", "party", "cap", "eps", "regime", "q").agg(F.max("lo.n").alias("lo"), F.min("hi.n").alias("hi"))
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("string"), F.lit("/400")))
    per = F.to_json(F.struct(F.lit(0).alias("lo"), F.array().cast("array<int>").alias("unknown"), text("lo").alias("best_margin"), text("hi").alias("hi_m")))
    entry = F.struct(F.col("q").cast("string").alias("key"), per.alias("value"))
    docs = f.groupBy("tag", "state", "party", "cap", "eps", "regime").agg(F.collect_list(entry).alias("e"))
    one = F.array(F.struct(F.lit("regime").alias("key"), F.col("regime").alias("value")))
    return docs.select("tag", F.concat_ws("_", "state", "party", F.col("cap").cast("string")).alias("job"), F.lit(1.0).alias("seconds"), "state", "party", "cap", "eps",
                       F.array(F.lit("A")).alias("contests"), F.map_from_entries(F.when(F.col("regime") == "feasible", F.concat("e", one)).otherwise(one)).alias("spectrum"))


@query(_with(FACT) + """SELECT tag, state, party, cap, eps, regime, q, lo, hi FROM (SELECT tag, state, party, cap, eps, regime, q, max(lo) AS lo, min(hi) AS hi FROM fact WHERE regime = 'feasible' GROUP BY ALL)
UNION ALL SELECT DISTINCT tag, state, party, cap, eps, regime, NULL::INTEGER, NULL, NULL FROM fact WHERE regime <> 'feasible'""")
def run_document_facts(spark, d):
    return RU.facts(_run_documents(spark, d)).select("tag", "state", "party", "cap", "eps", "regime", "q", _n("lo"), _n("hi"))


@query(_with(FACT) + "SELECT state, party, cap, eps, q, 'free' AS status, NULL::BIGINT AS lo, hi FROM merged WHERE hi IS NOT NULL")
def bound_documents(spark, d):
    free = _merged(spark, d).where("hi is not null").select(*B.KEY, "q", "hi")
    return RU.bound_docs(free, "free").select(*B.KEY, "q", "status", _n("lo"), _n("hi"))


@query(_with(NATION, STATS) + f""", ok AS (SELECT plan, valid FROM ({ORACLE["verify_plan"]}) v)
SELECT r.plan, r.q::INTEGER AS q FROM ranked r JOIN ok USING (plan) WHERE NOT (valid AND abs(r.margin - r.q / 100.0::DOUBLE) < 1e-15)""")
def plan_reverification(spark, d):
    inst, plans = X.nation(spark, d), X.nation_plans(spark, d)
    claims = D.ranked(D.robust_margins(inst, plans, BOTH)).select("plan", F.col("q").cast("int").alias("q"), F.struct(F.col("q").cast("bigint").alias("n"), F.lit(100).cast("bigint").alias("d")).alias("margin"))
    return verify.reverify(inst, plans, claims, BOTH).select("plan", "q")


@query(_with(FACT) + """SELECT state, party, cap / 4.0::DOUBLE AS frac, (1000 * cap)::INTEGER AS atoms, q, hi - lo AS width FROM merged WHERE eps = '1/100' AND lo IS NOT NULL AND hi IS NOT NULL""")
def resolution_ladder(spark, d):
    docs = _merged(spark, d).where("eps = '1/100' and lo is not null and hi is not null")
    docs = docs.withColumn("frac", F.col("cap") / F.lit(4.0)).withColumn("atoms", (F.col("cap") * 1000).cast("int"))
    return reports.ladder(docs).withColumn("width", F.round(F.col("width") * 4).cast("bigint"))


# Decisions (rows only; tests compare them with enumeration)

@query()
def decide_cells(spark, d):
    """Status of each q at four margins, over the cells of the nation instance."""
    i = X.nation(spark, d)
    r = [Regime(p, (0, 1), (1, 5), ("A",), None) for p in "DR"]
    asked = spark.createDataFrame([(j, q, n, n, 100) for j in range(2) for q in range(1, 6) for n in (-5, 0, 2, 20)], DC.ASKED)
    a = DC.answers(i, 5, r, asked, 1500)
    return a.select("job", "q", "n", "d", "status", "cells", "achieved_n", "achieved_d")


@query()
def spectrum_brackets(spark, d):
    """Run documents of the nation instance cut in two, read as facts."""
    i = X.nation(spark, d)
    docs = DC.run_documents(i, "N", 2, [Regime(p, (0, 1), (1, 20), ("A",), None) for p in "DR"], 50, 3000)
    first = F.get("records", F.lit(0))
    facts = RU.facts(docs.withColumn("tag", F.lit("main")).select("tag", "job", "seconds", "state", "party", "spectrum", *[first[c].alias(c) for c in ("cap", "eps", "contests")]))
    return facts.select("state", "party", "cap", "eps", "regime", "q", "lo", "hi", "unknown")


# Jobs still open, places, trees and the published numbers

SEATS = "seat AS (SELECT DISTINCT state, (2 + substr(state, 2)::INTEGER % 4)::INTEGER AS k FROM merged)"


def _seats(merged):
    return merged.select("state").distinct().withColumn("k", (F.substring("state", 2, 9).cast("int") % 4 + 2).cast("int"))


@query(_with(FACT) + "SELECT DISTINCT state, party, cap, eps FROM merged WHERE NOT coalesce(lo IS NULL AND hi <= 0, false) AND coalesce(hi - lo > 8, true)")
def escalation_jobs(spark, d):
    return B.open_jobs(_merged(spark, d), (1, 50), "escalate")


@query(_with(FACT, SEATS) + "SELECT DISTINCT state, party, cap, eps FROM merged JOIN seat USING (state) WHERE q < k AND hi > 0 AND (lo IS NULL OR hi - lo > 8)")
def sweep_jobs(spark, d):
    m = _merged(spark, d)
    return B.open_jobs(m, (1, 50), "sweep", _seats(m))


@query(_with(FACT) + "SELECT DISTINCT state, party, cap, eps FROM merged WHERE state || '_' || party IN ('S1_D', 'S2_R', 'S30_D')")
def job_filter(spark, d):
    return B.named_jobs(_merged(spark, d).select(*B.KEY).distinct(), ["S1_D", "S2_R", "S30_D"])


@query("""WITH b AS (SELECT o_custkey AS atom_id, ascii(o_orderstatus) * 10 + o_orderkey % 3 AS county, sum(floor(o_totalprice))::BIGINT AS pop FROM orders GROUP BY ALL),
f AS (SELECT atom_id, arg_min(county, (-pop, county)) AS county FROM b GROUP BY atom_id)
SELECT count(*) AS atoms, count(*) FILTER (f.county IS DISTINCT FROM CASE WHEN c_nationkey > 0 THEN 700 + c_nationkey * 10 % 100 + c_custkey % 3 END) AS disagree FROM f JOIN customer ON c_custkey = atom_id""")
def county_disagreement(spark, d):
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    said = F.when(nation > 0, 700 + nation * 10 % 100 + key % 3).cast("bigint")
    return I.disagreeing(I.plurality(_blocks(spark, d), "county"), X.read(spark, d, "customer").select(key.alias("atom_id"), said.alias("county")))


@query("SELECT c_custkey AS id, greatest(0, least(3, floor(c_acctbal / 2000)))::BIGINT AS poly_id FROM customer")
def district_of_block(spark, d):
    p = X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.5).alias("y"))
    return I.in_districts(p, _strips(spark), 1000.0)


@query("""WITH b AS (SELECT c_nationkey AS atom_id, greatest(0, least(3, floor(c_acctbal / 2000)))::BIGINT AS poly_id, sum(c_custkey % 4)::BIGINT AS pop FROM customer WHERE c_custkey % 4 > 0 AND c_nationkey % 6 <> 1 GROUP BY ALL),
m AS (SELECT atom_id, arg_min(poly_id, (-pop, poly_id)) AS poly_id FROM b GROUP BY atom_id)
SELECT n_nationkey AS atom_id, coalesce(poly_id, greatest(0, least(3, (500 * n_nationkey - 1300) // 2000)))::BIGINT AS poly_id FROM nation LEFT JOIN m ON atom_id = n_nationkey""")
def enacted_plan(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    b = X.read(spark, d, "customer").where(nation % 6 != 1).select(key.alias("id"), nation.alias("atom_id"), (key % 4).alias("pop"), F.col("c_acctbal").alias("x"), F.lit(0.5).alias("y"))
    a = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("atom_id"), (F.col("n_nationkey") * 500.0 - 1300.0).alias("x"), F.lit(0.25).alias("y"))
    return I.enacted_plan(b, a, _strips(spark), 1000.0)


@query(_with(CUSTOMER, CELLS) + "SELECT c.cell, CASE WHEN min(county) = max(county) THEN min(county) END AS outer_cell, min(county) = max(county) AS one FROM cell_of c JOIN atom USING (atom_id) GROUP BY c.cell")
def nested_cells(spark, d):
    i = X.customer(spark, d)
    return C.nested(_cells(i), i.atom.select("atom_id", F.col("county").alias("cell"))).withColumnRenamed("outer", "outer_cell")


@query(_with(CUSTOMER, CELLS) + "SELECT county AS cell, CASE WHEN min(c.cell) = max(c.cell) THEN min(c.cell) END AS outer_cell, min(c.cell) = max(c.cell) AS one FROM cell_of c JOIN atom USING (atom_id) GROUP BY county")
def straddled_cells(spark, d):
    i = X.customer(spark, d)
    return C.nested(i.atom.select("atom_id", F.col("county").alias("cell")), _cells(i)).withColumnRenamed("outer", "outer_cell")


@query("SELECT sum(floor(o_totalprice))::BIGINT AS blocks, (SELECT sum(floor(o_totalprice))::BIGINT FROM customer JOIN orders ON o_custkey = c_custkey) AS atoms FROM orders")
def population_totals(spark, d):
    atoms = X.read(spark, d, "customer").select(F.col("c_custkey").alias("atom_id"))
    b = _blocks(spark, d)
    return b.agg(F.sum("pop").alias("blocks")).join(I.atom_population(atoms, b).agg(F.sum("pop").alias("atoms")))


@query(_with(NATION) + "SELECT u::BIGINT AS u, v::BIGINT AS v FROM edge")
def polygon_adjacency_grid(spark, d):
    x, y = F.col("x"), F.col("y")
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return I.adjacency(X.nation(spark, d).atom.select(F.col("atom_id").cast("bigint").alias("poly_id"), ring.alias("ring")), 0.001, 0.5)


PLANE = """w AS (SELECT atom_id, 1 AS cell, greatest(pop, 1)::DOUBLE AS w, x, y FROM pts),
m AS (SELECT cell, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS cxx,
      sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) AS cyy, sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS cxy FROM w GROUP BY cell),
ax AS (SELECT *, (cxx - cyy) / 2 + sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS top FROM m),
p AS (SELECT w.*, ax.n, ax.sw, round((x - mx) * top + (y - my) * cxy, 6) AS proj FROM w JOIN ax USING (cell)),
o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY proj, atom_id) AS i, sum(w) OVER (PARTITION BY cell ORDER BY proj, atom_id ROWS UNBOUNDED PRECEDING) AS cum FROM p),
c AS (SELECT cell, least(greatest(min(i), 1), any_value(n) - 1) AS cut FROM o WHERE cum * 2 >= sw GROUP BY cell)"""
POINTS = "pts AS (SELECT s_suppkey::INTEGER AS atom_id, (s_suppkey % 5)::BIGINT AS pop, (s_suppkey * 7 % 31)::DOUBLE AS x, (s_suppkey * 7 % 31 + s_suppkey * 11 % 17 * 2)::DOUBLE AS y FROM supplier)"


def _plane(spark, d):
    s = F.col("s_suppkey")
    a = X.read(spark, d, "supplier").select(s.cast("int").alias("atom_id"), F.lit(None).cast("string").alias("geoid"), F.lit(1).alias("county"), (s % 5).cast("bigint").alias("pop"),
                                            (s * 7 % 31).cast("double").alias("x"), (s * 7 % 31 + s * 11 % 17 * 2).cast("double").alias("y"))
    n = X.nation(spark, d)
    return Instance(a, n.vote, n.edge)


@query(_with(POINTS, PLANE) + "SELECT atom_id, cell, (i > cut)::INTEGER AS side FROM o JOIN c USING (cell)")
def median_split_plane(spark, d):
    i = _plane(spark, d)
    return C.median_split(i, i.atom.select("atom_id", F.lit(1).alias("cell")))


def _level(n: int) -> str:
    """SQL of the second split, of the cells that the first one leaves."""
    out = PLANE.replace("1 AS cell", "2 + side AS cell").replace("FROM pts)", "FROM pts JOIN first USING (atom_id))")
    for t in ("w", "m", "ax", "p", "o", "c"):
        out = out.replace(f"\n{t} AS (", f"\n{t}{n} AS (").replace(f"FROM {t} ", f"FROM {t}{n} ").replace(f"FROM {t})", f"FROM {t}{n})").replace(f"JOIN {t} ", f"JOIN {t}{n} ")
    return "w2 AS (" + out.removeprefix("w AS (").replace("SELECT w.*, ax.n, ax.sw", "SELECT w2.*, ax2.n, ax2.sw")


@query(_with(POINTS, PLANE, "first AS (SELECT atom_id, (i > cut)::INTEGER AS side FROM o JOIN c USING (cell))", _level(2))
       + """SELECT 0 AS level, 1::BIGINT AS node, atom_id FROM pts UNION ALL SELECT 1, 2 + side, atom_id FROM first UNION ALL SELECT 2, 2 * cell + (i > cut)::INTEGER, atom_id FROM o2 JOIN c2 USING (cell)""")
def bisection_tree(spark, d):
    i = _plane(spark, d)
    return C.bisected(i, i.atom.select("atom_id", F.lit(1).alias("cell")), 2)


NUMBERS = """m AS (SELECT * FROM merged WHERE cap = 1 AND eps = '1/100'),
seat AS (SELECT DISTINCT state, 2 + substr(state, 2)::INTEGER % 4 AS k FROM m),
b AS (SELECT m.*, k, """ + WIDTH + """ AS w FROM m JOIN seat USING (state) WHERE q <= k),
f AS (SELECT state, party, k, g.n, g.d, coalesce(max(CASE WHEN lo * g.d >= g.n * 400 THEN q END), 0) AS f_lo, coalesce(max(CASE WHEN hi IS NULL OR g.n * 400 < hi * g.d THEN q END), 0) AS f_hi
      FROM b CROSS JOIN (VALUES (0, 1), (1, 20), (1, 10)) g(n, d) GROUP BY ALL),
r AS (SELECT a.k, a.k - z.f_lo AS ver_min, a.f_lo AS ver_max, a.k - z.f_hi AS lim_min, a.f_hi AS lim_max FROM f a JOIN f z ON a.state = z.state AND a.n = 0 AND z.n = 0 AND a.party = 'D' AND z.party = 'R'),
en AS (SELECT state, party, q, 46 + (q * 3 + substr(state, 2)::INTEGER) % 9 AS share FROM b),
ck AS (SELECT state, substr(state, 2)::INTEGER % 3 <> 0 AS in_regime, substr(state, 2)::INTEGER % 11 // 10 AS violations FROM seat),
gp AS (SELECT q, 100 * (lo / 400.0::DOUBLE) + 50 - share AS gap FROM b JOIN en USING (state, party, q) WHERE lo > 0),
ab AS (SELECT state, party, q, s - 10 + q AS free, s - 8 + q AS cells, s - 9 + q AS refined, (s - 14) / 400.0::DOUBLE AS search FROM (SELECT state, party, q, coalesce(hi, lo) + 3 * (q % 3) AS s FROM m WHERE coalesce(hi, lo) IS NOT NULL)),
aj AS (SELECT q, 100 * ((least(cells, refined) - free) / 400.0::DOUBLE) AS loss, 100 * ((free - hi) / 400.0::DOUBLE) AS gain, CASE WHEN search >= 0 THEN 100 * (lo / 400.0::DOUBLE - search) END AS over
       FROM b JOIN ab USING (state, party, q) WHERE lo IS NOT NULL OR free > 0),
au AS (SELECT ['main', 'k2', 'stored'][o_orderkey % 3 + 1] AS name, CASE o_orderstatus WHEN 'F' THEN 'agree' WHEN 'O' THEN 'unknown' ELSE 'disagree' END AS verdict FROM orders)"""


def _pairs(source: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, ({v})::DOUBLE AS value FROM {source}" for n, v in values.items())


AUDITS = {f"{label}_{v or 'total'}": f"count(*) FILTER (name = '{n}'" + (f" AND verdict = '{v}')" if v else ")")
          for n, label in (("main", "audit"), ("k2", "audit_k2"), ("stored", "stored")) for v in ("agree", "disagree", "unknown", "")}


@query(_with(FACT, NUMBERS) + "SELECT metric, round(value, 6) AS value FROM (" + " UNION ALL ".join((
    _pairs("seat", n_states="count(*)", seats="sum(k)"),
    _pairs("b", brackets="count(*)", tight_brackets="count(*) FILTER (w <= 0.5 + 1e-9)", k2_brackets="count(*) FILTER (k = 2)", k2_tight="count(*) FILTER (k = 2 AND w <= 0.5 + 1e-9)",
           **{f"median_k{i}": f"median(w) FILTER (k = {i})" for i in (3, 4, 5)}),
    _pairs("f", F_cases="count(*)", F_exact="count(*) FILTER (f_lo = f_hi)", F_exact_k2="count(*) FILTER (f_lo = f_hi AND k = 2)", F_exact_k345="count(*) FILTER (f_lo = f_hi AND k > 2)"),
    _pairs("r", D_verified_min="sum(ver_min)", D_verified_max="sum(ver_max)", D_limit_min="sum(lim_min)", D_limit_max="sum(lim_max)",
           forced_states="count(*) FILTER (ver_min = ver_max AND ver_max = lim_min AND lim_min = lim_max)", R_majority_states="count(*) FILTER ((k - ver_min) * 2 > k)", D_majority_states="count(*) FILTER (ver_max * 2 > k)"),
    _pairs("en", enacted_D="count(*) FILTER (party = 'D' AND share > 50)"),
    _pairs("ck", enacted_in_regime="count(*) FILTER (in_regime)", enacted_checked="count(*)", enacted_violations="sum(violations)"),
    _pairs("gp", enacted_below="count(*) FILTER (gap > 0)", enacted_gap_median="median(gap)", enacted_gap_q1_median="median(gap) FILTER (q = 1)"),
    _pairs("aj", abl_nontrivial="count(*)", abl_quot_median="median(loss)", abl_quot_min="min(loss)", abl_quot_max="max(loss)", abl_finite="count(gain)", abl_improved="count(*) FILTER (gain > 0.05)",
           abl_impr_median="median(gain)", abl_q1_median="median(gain) FILTER (q = 1)", abl_q1_min="min(gain) FILTER (q = 1 AND gain > 0.05)", abl_q1_max="max(gain) FILTER (q = 1)",
           recom_cmp="count(over)", recom_cert_higher="count(*) FILTER (over > 0)", recom_median="median(over)", recom_min="min(over)", recom_max="max(over)"),
    _pairs("au", **AUDITS),
    _pairs("(SELECT * FROM best WHERE lo >= hi)", consistency_violations="count(*)"),
    _pairs("(SELECT DISTINCT state, party, cap, eps FROM fact WHERE regime = 'feasible')", consistency_keys="count(*)"),
)) + ")")
def headline_numbers(spark, d):
    m = _merged(spark, d).where("cap = 1 and eps = '1/100'")
    seats, nth = _seats(m), F.substring("state", 2, 9).cast("int")
    over = lambda by: F.struct((F.col("s") + by + F.col("q")).alias("n"), F.lit(400).cast("bigint").alias("d"))
    a = m.withColumn("s", F.coalesce("hi.n", "lo.n") + F.col("q") % 3 * 3).where("s is not null")
    a = a.select("state", "party", "q", over(-10).alias("free"), over(-8).alias("cells"), over(-9).alias("refined"), ((F.col("s") - 14) / 400).alias("search"))
    enacted = m.join(seats, "state").where("q <= k").select("state", "party", "q", (46 + (F.col("q") * 3 + nth) % 9).alias("share"))
    checks = seats.select("state", (nth % 3 != 0).alias("in_regime"), F.floor(nth % 11 / 10).alias("violations"))
    verdict = F.when(F.col("o_orderstatus") == "F", "agree").when(F.col("o_orderstatus") == "O", "unknown").otherwise("disagree")
    audits = X.read(spark, d, "orders").select(F.expr("array('main', 'k2', 'stored')[o_orderkey % 3]").alias("name"), verdict.alias("verdict"))
    r = reports.headline_numbers(m, seats, grid(spark), enacted, checks, a, audits, X.bracket_facts(spark, d))
    return r.select("metric", F.round("value", 6).alias("value"))


# Ensembles of plans, bounds over several contests, lower ends by search, wide report lines

CURVES = "curve AS (SELECT plan, s AS swing, count(*) FILTER (margin + s / 100.0::DOUBLE >= 0) AS seats FROM margins CROSS JOIN (SELECT unnest(range(-20, 21)) AS s) GROUP BY ALL), mean AS (SELECT swing, avg(seats) AS mu FROM curve GROUP BY swing)"


def _curves(spark, d):
    plans = X.nation_plans(spark, d)
    curve = D.seat_curve(D.robust_margins(X.nation(spark, d), plans, BOTH), range(-20, 21))
    return curve, K.mean_curve(curve, plans.select("plan").distinct().withColumn("weight", F.lit(1.0)))


@query(_with(NATION, STATS, CURVES) + "SELECT swing::INTEGER AS swing, round(mu, 6) AS mu FROM mean")
def ensemble_mean_curve(spark, d):
    return _curves(spark, d)[1].select("swing", F.round("mu", 6).alias("mu"))


@query(_with(NATION, STATS, CURVES) + """, o AS (SELECT plan, (seats - mu) / 5 AS off FROM curve JOIN mean USING (swing))
SELECT plan, round(avg(off), 6) AS gamma, round(sqrt(avg(off * off)), 6) AS g FROM o GROUP BY plan""")
def ensemble_distances(spark, d):
    r = K.distances(*_curves(spark, d), 5)
    return r.select("plan", F.round("gamma", 6).alias("gamma"), F.round("g", 6).alias("g"))


FLOOR = _with(NATION, STATS, CURVES) + "SELECT round(sqrt(avg((mu - round_even(mu, 0)) * (mu - round_even(mu, 0)))) / 5, 9) AS floor FROM mean"


@query(FLOOR)
def pointwise_floor(spark, d):
    return K.pointwise_floor(_curves(spark, d)[1], 5).select(F.round("floor", 9).alias("floor"))


@query(FLOOR)  # the mean of rising curves rises, and then the nearest whole numbers rise too
def integrality_floor(spark, d):
    return K.integrality_floor(_curves(spark, d)[1], 5).select(F.round("floor", 9).alias("floor"))


@query(_with(NATION) + """, c AS (SELECT a.plan, count(*) FILTER (a.district <> b.district) AS n FROM edge JOIN plan a ON a.atom_id = u JOIN plan b ON b.atom_id = v AND a.plan = b.plan GROUP BY a.plan),
w AS (SELECT plan, exp(-1.0::DOUBLE * (n - (SELECT min(n) FROM c))) AS w FROM c) SELECT plan, round(1.0::DOUBLE / (SELECT count(*) FROM w), 9) AS uniform, round(w / (SELECT sum(w) FROM w), 9) AS cuts FROM w""")
def ensemble_weights(spark, d):
    w = K.weights(X.nation(spark, d), X.nation_plans(spark, d))
    return w.select("plan", F.round("uniform", 9).alias("uniform"), F.round("cuts", 9).alias("cuts"))


@query()
def spanning_trees(spark, d):
    return K.spanning_trees(X.nation(spark, d), X.nation_plans(spark, d))


@query()
def expected_seat_curve(spark, d):
    return K.expected_curve(D.robust_margins(X.nation(spark, d), X.nation_plans(spark, d), BOTH), range(-20, 21), 0.05)


@query(f"SELECT q, m_n, m_d, bool_and(possible) AS possible FROM (({ORACLE['geofree_bound']}) UNION ALL ({ORACLE['geofree_bound'].replace("contest = 'A'", "contest = 'B'")})) GROUP BY ALL")
def geofree_bound_of_all(spark, d):
    return C.geography_free_of_all(X.nation(spark, d), "D", ["A", "B"], grid(spark, FINE), 5, (1, 5))


@query()
def sigma_search(spark, d):
    return lower.sigma_search(X.nation(spark, d), Regime("D", (0, 1), (1, 5), ("A",), 8), 3, seeds=3, steps=40)


@query()
def best_lower_bound(spark, d):
    return lower.best_lower_bound(X.nation(spark, d), Regime("D", (0, 1), (1, 5), ("A",), None), 3, seeds=3, steps=40)


@query(f"""WITH c AS ({ORACLE['capacity_report']}) SELECT state || ' & ' || party || ' & ' || max(seats) FILTER (m_n = 0) || ' & ' || max(seats) FILTER (m_d = 20) || ' & ' || max(seats) FILTER (m_d = 10) || ' \\\\' AS line
FROM c WHERE cap = 1 AND eps = '1/100' GROUP BY state, party""")
def latex_capacity(spark, d):
    c = reports.capacity(_merged(spark, d), grid(spark)).where("cap = 1 and eps = '1/100'")
    return reports.latex_rows(reports.wide(c, ["state", "party"], F.concat_ws("/", "m_n", "m_d"), "seats", ["0/1", "1/20", "1/10"]))


@query(f"""WITH c AS ({ORACLE['spectrum_report_all']}) SELECT state || ' & ' || party || ' & ' || """ + " || ' & ' || ".join(
    f"coalesce(max(bracket || CASE WHEN wide THEN '$^\\dagger$' ELSE '' END) FILTER (q = {i}), '--')" for i in range(1, 6)) + " || ' \\\\' AS line FROM c WHERE cap = 1 AND eps = '1/100' GROUP BY state, party")
def latex_spectrum(spark, d):
    c = reports.spectrum(_merged(spark, d)).where("cap = 1 and eps = '1/100'")
    c = c.withColumn("shown", F.concat("bracket", F.when(F.col("wide"), r"$^\dagger$").otherwise("")))
    return reports.latex_rows(reports.wide(c, ["state", "party"], F.col("q").cast("string"), "shown", [str(i) for i in range(1, 6)]))
