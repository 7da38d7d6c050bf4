"""Margins, safety and population windows as column arithmetic on integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def party_votes(party: str, d: str = "d", r: str = "r") -> tuple[Column, Column]:
    """(own, other) votes for a party."""
    return (F.col(d), F.col(r)) if party == "D" else (F.col(r), F.col(d))


def safety_mass(p: Column, o: Column, m: tuple[int, int]) -> Column:
    """At least 0 exactly if p / (p + o) >= 1/2 + m."""
    a, b = m
    return F.lit(b - 2 * a) * p - F.lit(b + 2 * a) * o


def is_safe(p: Column, o: Column, m: tuple[int, int]) -> Column:
    """A district without votes is never safe above -1/2."""
    if 2 * m[0] <= -m[1]:
        return F.lit(True)
    return (p + o > 0) & (safety_mass(p, o, m) >= 0)


def margin(p: Column, o: Column) -> Column:
    """p / (p + o) - 1/2 by one division; -1/2 without votes."""
    return F.when(p + o > 0, (p - o) / (F.lit(2) * (p + o))).otherwise(F.lit(-0.5))


def pop_window(total: Column, k: Column, eps: tuple[int, int]) -> tuple[Column, Column]:
    """Least and largest population of a district, both exact."""
    a, b = eps
    t = total.cast("bigint")
    low, high = F.lit(b - a) * t + F.lit(b) * k - 1, F.lit(b + a) * t
    bk = F.lit(b) * k
    whole = lambda x: ((x - F.pmod(x, bk)) / bk).cast("bigint")  # noqa: E731  the division leaves no rest
    return whole(low), whole(high)


def in_percent(margin_: Column) -> Column:
    return F.lit(50.0) + F.lit(100.0) * margin_


__all__ = ["in_percent", "is_safe", "margin", "party_votes", "pop_window", "safety_mass"]
