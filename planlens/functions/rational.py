"""Exact fractions as struct<n:bigint,d:bigint>, d > 0.

Ordering goes through one division of exact integers: equal fractions give equal doubles, and distinct ones with
denominators up to 8e6 differ by far more than rounding. Thresholds multiply crosswise instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(s: Column) -> Column:
    """'a/b' or 'a'; null for text that is no fraction."""
    parts = F.split(s, "/")
    n, d = F.get(parts, F.lit(0)).cast("bigint"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).cast("bigint")
    return F.when(s.rlike(r"^-?[0-9]+(/[1-9][0-9]*)?$"), F.struct(n.alias("n"), d.alias("d")))


def of(n, d) -> Column:
    """A fraction from two integer columns, null where one is."""
    n, d = (x if isinstance(x, Column) else F.lit(x) for x in (n, d))
    return F.when(n.isNotNull() & d.isNotNull(), F.struct(n.cast("bigint").alias("n"), d.cast("bigint").alias("d")))


def value(r: Column) -> Column:
    return r["n"] / r["d"]


def at_least(r: Column, other: Column) -> Column:
    return r["n"] * other["d"] >= other["n"] * r["d"]


def less(r: Column, other: Column) -> Column:
    return r["n"] * other["d"] < other["n"] * r["d"]


def minus(r: Column, other: Column) -> Column:
    return F.struct((r["n"] * other["d"] - other["n"] * r["d"]).alias("n"), (r["d"] * other["d"]).alias("d"))


def text(r: Column) -> Column:
    return F.when(r["d"] == 1, r["n"].cast("string")).otherwise(F.concat_ws("/", r["n"], r["d"]))


def percent(r: Column) -> Column:
    """A margin as a share in percent."""
    return F.lit(50.0) + F.lit(100.0) * value(r)
