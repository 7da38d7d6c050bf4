"""Schemas and the instance: a graph of atoms with a county, a population and two-party votes by contest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

ATOM = "atom_id int, geoid string, county int, pop bigint, x double, y double"
VOTE = "atom_id int, contest string, d bigint, r bigint"
EDGE = "u int, v int"
PLAN = "plan string, k int, atom_id int, district int"

#: A run document: one job's brackets and decision records. q-keys are dynamic, hence the map.
RECORD = (
    "struct<state:string,party:string,cap:int,eps:string,contests:array<string>,q:int,m:string,status:string,seconds:double,"
    "iters:int,cells:int,achieved_margin:string,plan_hash:string,part_nodes:array<int>>"
)
RUN_DOC = f"job string, seconds double, spectrum map<string,string>, records array<{RECORD}>"
SPECTRUM_Q = "lo int, hi int, unknown array<int>, best_margin string, lo_m string, hi_m string"


@dataclass(frozen=True)
class Instance:
    """atom, vote and edge (u < v) as DataFrames; votes hold a row for every atom and contest."""

    atom: DataFrame
    vote: DataFrame
    edge: DataFrame


@dataclass(frozen=True)
class Regime:
    """What a plan is judged by. m and eps are exact fractions (numerator, denominator); cap None is no limit."""

    party: str = "D"
    m: tuple[int, int] = (0, 1)
    eps: tuple[int, int] = (1, 100)
    contests: tuple[str, ...] = field(default=("A",))
    cap: int | None = None
