"""Connectivity of atoms under a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.model import Instance


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="planlens-")
        spark.sparkContext.setCheckpointDir(base)
    at = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def _hadoop(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _drop(spark: SparkSession, df_at: str) -> None:
    fs, path = _hadoop(spark, df_at)
    fs.delete(path, True)


def _cut(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written to the shared folder and read again, so that lineage stays short."""
    at = at or _folder(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, most_rounds: int = 200) -> DataFrame:
    """Adds label to nodes (by..., atom_id): the least atom that edges (by..., u, v) connect it with.

    Each round takes the least label among neighbours and then that label's own label, so distances halve.
    """
    by = by or []
    e = _cut(edges.select(*by, "u", "v").unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    spark = nodes.sparkSession
    old = _folder(spark)
    now = _cut(nodes.select(*by, "atom_id", F.col("atom_id").alias("label")), old)
    for _ in range(most_rounds):
        near = e.join(now.withColumnsRenamed({"atom_id": "v", "label": "near"}), [*by, "v"]).groupBy(*by, "u").agg(F.min("near").alias("near"))
        step = now.join(near.withColumnRenamed("u", "atom_id"), [*by, "atom_id"], "left").select(*by, "atom_id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        half, new = _folder(spark), _folder(spark)
        step = _cut(step, half)
        # Only labels that others point to are looked up; few are, and partial sums find them.
        roots = step.select(*by, F.col("new").alias("atom_id")).distinct()
        jump = step.join(roots, [*by, "atom_id"], "left_semi").select(*by, F.col("atom_id").alias("new"), F.col("new").alias("far")).where("far != new")
        nxt = _cut(step.join(jump, [*by, "new"], "left").select(*by, "atom_id", "label", F.least("new", F.coalesce("far", "new")).alias("new")), new)
        done = nxt.where("label != new").isEmpty()
        for at in (old, half):
            _drop(spark, at)
        if done:
            return nxt.select(*by, "atom_id", "label")
        now, old = nxt.select(*by, "atom_id", F.col("new").alias("label")), new
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def district_components(inst: Instance, plans: DataFrame) -> DataFrame:
    """plan, district, parts: connected parts of each district that has atoms."""
    d = plans.select("plan", "atom_id", "district")
    inner = inst.edge.join(d.withColumnsRenamed({"atom_id": "u", "district": "du"}), "u").join(d.withColumnsRenamed({"atom_id": "v", "district": "dv"}), ["plan", "v"]).where("du = dv")
    found = components(d.select("plan", "atom_id"), inner.select("plan", "u", "v"), ["plan"])
    return found.join(d, ["plan", "atom_id"]).select("plan", "district", "label").distinct().groupBy("plan", "district").agg(F.count("*").alias("parts"))


def county_components(inst: Instance) -> DataFrame:
    """atom_id, county, label: connected parts of each county."""
    c = inst.atom.select("atom_id", "county")
    inner = inst.edge.join(c.withColumnsRenamed({"atom_id": "u", "county": "cu"}), "u").join(c.withColumnsRenamed({"atom_id": "v", "county": "cv"}), "v").where("cu = cv")
    return components(c.select("atom_id"), inner.select("u", "v")).join(c, "atom_id")


def bridges(nodes: DataFrame, edges: DataFrame) -> list[tuple[int, int, float]]:
    """Edges that join all components to the one of most population, nearest atoms first. nodes: atom_id, pop, x, y.

    A component at a time, by population: the main one takes in the next by its nearest pair of atoms, found in cells of
    a grid whose width grows until a pair is seen. Atoms without a place can't be joined, nor can components of only such.
    """
    found = _cut(components(nodes.select("atom_id"), edges).join(nodes.where("x is not null and y is not null"), "atom_id"))
    order = [r.label for r in found.groupBy("label").agg(F.sum("pop").alias("pop")).orderBy(F.col("pop").desc(), "label").collect()]
    out, main = [], order[:1]
    for label in order[1:]:
        a, b = found.where(F.col("label") == label), found.where(F.col("label").isin(main))
        dist = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by_")) ** 2)
        width = 1.0
        while True:
            cell = lambda c, w=width: F.floor(c / w)
            near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
            left = a.select("atom_id", "x", "y", cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j")).withColumn("di", near).withColumn("dj", near)
            left = left.select("atom_id", "x", "y", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
            right = b.select(F.col("atom_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by_"), cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j"))
            pairs = left.join(right, ["i", "j"]).select(dist.alias("dist"), "atom_id", "b_id").where(F.col("dist") <= width)
            best = pairs.agg(F.min(F.struct("dist", "atom_id", "b_id")).alias("m")).first().m
            if best is not None:
                out.append((min(best.atom_id, best.b_id), max(best.atom_id, best.b_id), best.dist))
                break
            width *= 2
        main.append(label)
    return out
