"""Instances derived from the star-schema test tables.

``nation``: 25 atoms on a 5 x 5 grid, county = region, population = customers, votes = orders by status (F against O) in
two contests (urgent priorities, and the rest). ``customer``: one atom for each customer, county = nation, edges between
neighbouring keys within a nation. Brackets come from orders. Synthetic; used for tests, queries and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.model import Instance

CONTESTS = ("A", "B")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contest():
    return F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("A")).otherwise(F.lit("B"))


def _dense(atoms: DataFrame, votes: DataFrame) -> DataFrame:
    """A row for every atom and contest."""
    every = atoms.select("atom_id", F.explode(F.array(*map(F.lit, CONTESTS))).alias("contest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(votes, ["atom_id", "contest"], "left").select("atom_id", "contest", zero("d"), zero("r"))


def _count(status: str):
    return F.count_if(F.col("o_orderstatus") == status)


def nation(spark: SparkSession, sf_dir: str) -> Instance:
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    pop = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("pop"))
    n = read(spark, sf_dir, "nation").join(F.broadcast(pop), "n_nationkey", "left")
    key = F.col("n_nationkey").cast("int")
    atom = n.select(key.alias("atom_id"), F.col("n_name").alias("geoid"), F.col("n_regionkey").cast("int").alias("county"),
                    F.coalesce("pop", F.lit(0)).cast("bigint").alias("pop"), (key % 5).cast("double").alias("x"), F.floor(key / 5).cast("double").alias("y"))
    # Orders shrink to customers before they meet nations.
    by = orders.groupBy(F.col("o_custkey").alias("c_custkey"), _contest().alias("contest")).agg(_count("F").alias("d"), _count("O").alias("r"))
    votes = by.join(customer.select("c_custkey", F.col("c_nationkey").cast("int").alias("atom_id")), "c_custkey").groupBy("atom_id", "contest").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    key = F.col("atom_id")
    right = atom.where(key % 5 < 4).select(key.alias("u"), (key + 1).alias("v"))
    down = atom.where(key < 20).select(key.alias("u"), (key + 5).alias("v"))
    return Instance(atom, _dense(atom, votes), right.unionByName(down))


def customer(spark: SparkSession, sf_dir: str) -> Instance:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("int")
    atom = c.select(key.alias("atom_id"), F.col("c_name").alias("geoid"), F.col("c_nationkey").cast("int").alias("county"), F.lit(1).cast("bigint").alias("pop"),
                    F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    votes = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("int").alias("atom_id"), _contest().alias("contest")).agg(_count("F").alias("d"), _count("O").alias("r"))
    # Neighbours are found within ranges of keys, so no nation is one task; one edge joins a range to the one before.
    return Instance(atom, _dense(atom, votes), chain(atom))


def chain(atom: DataFrame, width: int = 4096) -> DataFrame:
    """Edges between neighbouring ids of a county, found in ranges of ids."""
    a = atom.select("county", "atom_id", F.floor(F.col("atom_id") / width).alias("range"))
    inner = a.withColumn("u", F.lag("atom_id").over(W.partitionBy("county", "range").orderBy("atom_id"))).where("u is not null").select("u", F.col("atom_id").alias("v"))
    ends = a.groupBy("county", "range").agg(F.min("atom_id").alias("v"), F.max("atom_id").alias("last"))
    seam = ends.withColumn("u", F.lag("last").over(W.partitionBy("county").orderBy("range"))).where("u is not null").select("u", "v")
    return inner.unionByName(seam)


def _plans(atoms: DataFrame, *plans) -> DataFrame:
    each = F.array(*[F.struct(F.lit(name).alias("plan"), F.lit(k).alias("k"), d.cast("int").alias("district")) for name, k, d in plans])
    return atoms.select("atom_id", F.explode(each).alias("p")).select("p.plan", "p.k", "atom_id", "p.district")


def nation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("atom_id")
    atoms = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("atom_id"))
    return _plans(atoms, ("row", 5, F.floor(key / 5)), ("col", 5, key % 5), ("mod4", 4, key % 4), ("one", 5, F.lit(0)))


def customer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("atom_id")
    atoms = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("atom_id"), F.col("c_nationkey").alias("nation"))
    return _plans(atoms, ("key5", 5, key % 5), ("nation5", 5, F.col("nation") % 5))


def bracket_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bracket end or two from each order: (tag, state, party, cap, eps, q, regime, seconds, lo, hi) with fractions over 400."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    state, q = F.floor(cust / 5) % 40, cust % 5 + 1
    base = state * 7 % 160 - 60 - 8 * q
    lo_n = F.when(key % 3 == 0, base - key % 29)
    hi_n = F.when(key % 4 == 1, F.when(key % 101 == 0, base - 20).otherwise(base + 1 + key % 31))
    frac = lambda n: F.when(n.isNotNull(), F.struct(n.cast("bigint").alias("n"), F.lit(400).cast("bigint").alias("d")))
    eps = F.element_at(F.array(*map(F.lit, ("1/200", "1/100", "1/50"))), (F.floor(key / 16) % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), (key % 7).cast("string")).alias("tag"), F.concat(F.lit("S"), state.cast("string")).alias("state"),
        F.when(F.floor(key / 64) % 2 == 0, F.lit("D")).otherwise(F.lit("R")).alias("party"), (F.floor(key / 4) % 4 + 1).cast("int").alias("cap"), eps.alias("eps"),
        q.cast("int").alias("q"), F.when(key % 17 == 0, F.lit("unknown")).otherwise(F.lit("feasible")).alias("regime"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("seconds"), frac(lo_n).alias("lo"), frac(hi_n).alias("hi"),
    )
