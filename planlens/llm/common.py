"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.shipping import ship as ship_source

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession, *files: str) -> None:
    """Makes Python workers ready: this package's source and, where an operator reads any, vocabulary files."""
    ship_source(spark)
    for f in files:
        spark.sparkContext.addFile(f)


def shipped(path: str) -> str:
    """Where a worker finds a file that the driver knows as path."""
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; removed when the driver ends.

    Only where that is unset and Spark runs in one process (local tests) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    at = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    for made in _SCRATCH:
        made.append(at)
    return at


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders that shared_dir() makes inside are removed at the end; what is still to be read must be written before."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH[:] = [x for x in _SCRATCH if x is not made]
        for at in made:
            drop_written(spark, at)


def _hadoop(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


@contextmanager
def small_batches(spark: SparkSession):
    """Fewer rows in a batch for Python while something is written, where the session has Spark's own default: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, "1000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written go when it is: nothing reads them again, and Spark keeps them until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = at or shared_dir(spark)
    with small_batches(spark), shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_written(spark: SparkSession, at: str) -> None:
    """Removes a folder made by shared_dir()."""
    fs, path = _hadoop(spark, at)
    fs.delete(path, True)


def local_path(uri: str) -> str:
    return uri[len("file:"):].replace("//", "/", 1) if uri.startswith("file:") else uri


def opener(uri: str):
    """(file system, path) for a URI of any store that pyarrow reaches; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), os.path.normpath(local_path(uri))
    return fs.FileSystem.from_uri(uri)
