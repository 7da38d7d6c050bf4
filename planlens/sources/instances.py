"""Instances and plans as Parquet, and synthetic grids."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.model import ATOM, EDGE, VOTE, Instance


def save(inst: Instance, name: str, path: str) -> None:
    """Writes the three tables below path, partitioned by instance; only this instance is replaced."""
    for part in ("atom", "vote", "edge"):
        df = getattr(inst, part).withColumn("instance", F.lit(name))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instance").parquet(f"{path}/{part}")


def load(spark: SparkSession, name: str, path: str) -> Instance:
    """One instance; the partition filter keeps other instances unread."""
    read = lambda part: spark.read.parquet(f"{path}/{part}").where(F.col("instance") == name).drop("instance")
    return Instance(read("atom"), read("vote"), read("edge"))


def grid(spark: SparkSession, rows: int, cols: int, seed: int = 0, diagonals: bool = True, popmax: int = 4, counties: int = 1) -> Instance:
    """A random toy: a grid with some diagonals, populations 1..popmax, one contest A that leans by waves over the grid, counties as bands of columns; the same for a seed."""
    r = np.random.default_rng(seed)
    n = rows * cols
    i, j = np.divmod(np.arange(n), cols)
    pop = 1 + r.permutation(n) % popmax
    wave = np.sin(r.uniform(0, 6) + 1.7 * i / rows) + np.cos(r.uniform(0, 6) + 2.3 * j / cols)
    total = 15 * pop + r.integers(0, 12, n)
    d = np.round(total * (0.5 + 0.12 * wave + r.uniform(-0.1, 0.1, n))).astype(np.int64)
    edges = [(a, a + 1) for a in range(n) if a % cols < cols - 1] + [(a, a + cols) for a in range(n - cols)]
    if diagonals:
        edges += [(a, a + cols + 1) for a in range(n - cols) if a % cols < cols - 1 and r.random() < 0.5]
    county = j * counties // cols
    atom = pd.DataFrame({"atom_id": np.arange(n), "geoid": [f"g{a}" for a in range(n)], "county": county, "pop": pop, "x": j.astype(float), "y": i.astype(float)})
    vote = pd.DataFrame({"atom_id": np.arange(n), "contest": "A", "d": d, "r": total - d})
    return Instance(spark.createDataFrame(atom, ATOM), spark.createDataFrame(vote, VOTE), spark.createDataFrame(pd.DataFrame(edges, columns=["u", "v"]), EDGE))


def plan_hash(districts) -> str:
    """The first 16 hex digits of the SHA-256 of the districts, in order of atoms, as little-endian int16."""
    return hashlib.sha256(np.asarray(districts, "<i2").tobytes()).hexdigest()[:16]


def plan_hashes(plans: DataFrame) -> DataFrame:
    """plan, plan_hash; the bytes are put together from two hex digits a byte, without Python."""
    b = lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(65536)))), 4, "0")
    little = lambda x: F.concat(F.substring(b(x), 3, 2), F.substring(b(x), 1, 2))
    per = plans.groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("atom_id", "district"))).alias("d"))
    return per.select("plan", F.substring(F.sha2(F.unhex(F.array_join(F.transform("d", lambda x: little(x["district"])), "")), 256), 1, 16).alias("plan_hash"))


def from_archive(records: DataFrame, archive: DataFrame) -> DataFrame:
    """Records joined with the plans (plan, ...) whose hash is theirs."""
    return records.join(archive.join(plan_hashes(archive), "plan"), "plan_hash")
