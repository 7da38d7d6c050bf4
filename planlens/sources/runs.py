"""Run documents (JSON): readers, sinks, and resuming from what is finished."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.functions import rational as R
from planlens.model import RUN_DOC, SPECTRUM_Q

#: Schemas of the other kinds of documents; q-keys are dynamic.
ABLATION = (
    "state string, party string, q map<string,struct<geo_free_ub:string,county_quotient_ub:string,county_quotient_refined_ub:string,"
    "cells_county:int,cells_refined:int,recom_lb:double,seconds:double>>"
)
ENACTED = (
    "state string, k int, cd118 array<string>, pop_in_split_precincts bigint, max_pop_dev double, D struct<shares_pct:array<double>,wins:int>,"
    "R struct<shares_pct:array<double>,wins:int>, split_counties int, components_per_district array<int>, assign_hash string"
)
_SOLVER = "struct<status:string,seconds:double>"
BASELINE = f"time_limit double, results array<struct<state:string,party:string,q:int,m:string,n_atoms:int,cegar:{_SOLVER},cpsat_atomic:{_SOLVER},milp_atomic:{_SOLVER}>>"
AUDIT = "agree bigint, disagree bigint, unknown bigint"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one kind, one a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_runs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Run documents of several tags (tag: path or glob) with tag and the first record's identity; audits and documents without records are left out."""
    out = None
    for tag, path in paths.items():
        d = read_json(spark, path, RUN_DOC).withColumn("tag", F.lit(tag))
        out = d if out is None else out.unionByName(d)
    first = F.get("records", F.lit(0))
    out = out.where(~F.col("file").startswith("audit") & (F.size("records") > 0))
    return out.select("tag", "job", "seconds", "spectrum", "records", *[first[c].alias(c) for c in ("state", "party", "cap", "eps", "contests")])


def facts(runs: DataFrame) -> DataFrame:
    """A row for each run and q: lo (best margin) and hi as fractions; runs that aren't feasible have one row with q null."""
    d = runs.select("tag", "job", "seconds", "state", "party", "cap", "eps", "contests", F.col("spectrum")["regime"].alias("regime"),
                    F.explode_outer(F.map_filter("spectrum", lambda k, _: k.rlike("^[0-9]+$"))).alias("key", "text"))
    q = F.from_json("text", SPECTRUM_Q)
    return d.select("tag", "job", "seconds", "state", "party", "cap", "eps", "contests", "regime", F.col("key").cast("int").alias("q"),
                    R.parse(q["best_margin"]).alias("lo"), R.parse(q["hi_m"]).alias("hi"), (F.size(q["unknown"]) > 0).alias("unknown"))


def records(runs: DataFrame) -> DataFrame:
    """Decision records; m stays text, since some are names of heuristics."""
    return runs.select("tag", "job", F.posexplode("records").alias("nth", "r")).select("tag", "job", "nth", "r.*")


def write_runs(docs: DataFrame, path: str) -> None:
    """One JSON line a document, by state and party, so that a job's output can be replaced alone."""
    docs.write.mode("overwrite").partitionBy("state", "party").json(path)


def bound_docs(results: DataFrame, status: str) -> DataFrame:
    """Facts with only a lower or upper end (state, party, cap, eps, q, lo or hi), ready for unionByName with other facts."""
    for c in ("lo", "hi"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast("struct<n:bigint,d:bigint>"))
    return results.withColumn("regime", F.lit("feasible")).withColumn("status", F.lit(status))


def remaining(jobs: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Jobs that have no finished row."""
    return jobs.join(finished.select(*key).distinct(), key, "left_anti")


def job_grid(seats: DataFrame, caps: list[str], parties: tuple[str, ...] = ("D", "R")) -> DataFrame:
    """state, party, cap for all combinations; caps are 'k-1', 'k', 'None' or a number; seats: state, k."""
    spec = F.explode(F.array(*map(F.lit, caps)))
    d = seats.select("state", "k", F.explode(F.array(*map(F.lit, parties))).alias("party")).withColumn("spec", spec)
    cap = F.when(F.col("spec") == "k-1", F.col("k") - 1).when(F.col("spec") == "k", F.col("k")).when(F.col("spec") == "None", F.lit(None)).otherwise(F.expr("try_cast(spec AS int)"))
    return d.select("state", "party", cap.cast("int").alias("cap"))
