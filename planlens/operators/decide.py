"""Decisions over cells: are there q safe districts? Answers are a plan, a proof that there is none, or unknown.

Atoms are grouped to cells, at first the connected parts of counties. A labelling gives each cell a district, or calls it
shared (a cell of one atom is never shared). It is a relaxation: whatever a plan does, calling its split cells shared
gives a labelling that passes every test below. So if no labelling passes, there is no plan. If one passes that shares
no cell, it is a plan. Else the shared cells are cut in two (by weight, along their principal axis) and it is tried
again. Labellings are searched depth first; a partial one is given up as soon as a district

- has more people than the window allows, or can't reach it with the cells that are still open;
- can't be safe: the best it can add from open cells, the densest atoms first up to its window, leaves it below;
- falls apart: its cells aren't joined through its own and open cells;

or as soon as the safe districts together can't be safe, or the counties are split more often than the cap allows.
All numbers are integers. A search that takes more than a number of steps says unknown, whatever the machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.model import RUN_DOC, Instance, Regime
from planlens.operators import search as S
from planlens.shipping import ship
from planlens.sources.instances import plan_hash

#: Steps of one search, times that cells are cut, and open jobs' answers that the driver holds (a row each).
MOST_STEPS, MOST_CUTS = 20_000, 60
OPEN, SHARED = -1, -2


def mass(g: S.Local, m: Fraction) -> np.ndarray:
    """contests x atoms: a district is safe at margin m in a contest if its masses sum to 0 or more (and it has votes)."""
    a, b = m.numerator, m.denominator
    return (b - 2 * a) * g.own - (b + 2 * a) * g.other


def first_cells(g: S.Local) -> list[np.ndarray]:
    """The connected parts of each county."""
    return [np.array(sorted(p)) for c in sorted(set(g.county.tolist())) for p in S.parts(g, set(np.flatnonzero(g.county == c).tolist()))]


def halves(g: S.Local, cell: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A cell cut at half its weight along its principal axis; at: x and y of all atoms."""
    w = np.maximum(g.pop[cell], 1).astype(float)
    x = at[cell] - np.average(at[cell], axis=0, weights=w)
    axis = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
    axis = axis if tuple(axis) >= (0.0, 0.0) else -axis
    order = np.lexsort((cell, np.round(x @ axis, 6)))
    z = int(np.clip(np.searchsorted(np.cumsum(w[order]), w.sum() / 2) + 1, 1, len(cell) - 1))
    return [np.sort(cell[order[:z]]), np.sort(cell[order[z:]])]


@dataclass
class Cells:
    """A partition of an instance into cells, with what the tests need."""

    g: S.Local
    cells: list[np.ndarray]
    masses: np.ndarray

    def __post_init__(self):
        g, n = self.g, len(self.cells)
        self.of = np.empty(g.n, np.int64)
        for i, c in enumerate(self.cells):
            self.of[c] = i
        self.pop = np.array([int(g.pop[c].sum()) for c in self.cells])
        self.total = np.array([[int(m[c].sum()) for c in self.cells] for m in self.masses])
        self.near = [sorted({int(self.of[v]) for u in c for v in g.near[u]} - {i}) for i, c in enumerate(self.cells)]
        self.county = np.array([int(g.county[c[0]]) for c in self.cells])
        self.single = np.array([len(c) == 1 for c in self.cells])
        # Atoms by density of mass, in each contest; those without people first or last.
        self.dense = []
        for m in self.masses:
            key = [(-(float("inf") if m[u] > 0 else 0.0 if m[u] == 0 else float("-inf")) if g.pop[u] == 0 else -m[u] / g.pop[u]) for u in range(g.n)]
            order = np.argsort(key, kind="stable")
            self.dense.append((order, self.of[order], g.pop[order].astype(np.int64), m[order].astype(np.int64)))
        # Cells are labelled outwards from the largest.
        self.order, seen = [], set()
        for start in np.argsort(-self.pop, kind="stable").tolist():
            front = [start] if start not in seen else []
            seen.update(front)
            while front:
                self.order += front
                front = sorted({v for u in front for v in self.near[u]} - seen, key=lambda v: -self.pop[v])
                seen.update(front)
        assert sorted(self.order) == list(range(n))

    def best_mass(self, w: int, open_: np.ndarray, least: int, most: int) -> int | None:
        """An upper bound of the mass of open cells' atoms with least..most people in all, parts of atoms allowed; None if there are too few."""
        _, of, pop, m = self.dense[w]
        pick = open_[of]
        pop, m = pop[pick], m[pick]
        people, sums = np.cumsum(pop), np.cumsum(m)
        if least > (int(people[-1]) if len(pop) else 0):
            return None
        gain = int(np.count_nonzero(m > 0))  # the densest come first, so that gains come before losses

        def upto(room: int, stop: int) -> int:
            """Mass of the first stop atoms as far as room people reach, the last in part (rounded up)."""
            z = min(int(np.searchsorted(people, room, "right")), stop)
            out = int(sums[z - 1]) if z else 0
            if z < stop and pop[z]:
                rest = room - (int(people[z - 1]) if z else 0)
                out -= (-int(m[z]) * rest) // int(pop[z])
            return out

        if gain and int(people[gain - 1]) >= least or least <= 0:
            return upto(max(most, 0), gain)
        return upto(least, len(pop))


def _joined(c: Cells, may: np.ndarray, must: np.ndarray, lo: int) -> bool:
    """Whether the cells that must be in a district lie in one piece of those that may be, and some such piece has lo people."""
    start = np.flatnonzero(must)
    todo = start[:1].tolist() if len(start) else np.flatnonzero(may).tolist()
    seen = np.zeros(len(may), bool)
    for s in todo:
        if seen[s]:
            continue
        piece, stack = 0, [s]
        seen[s] = True
        while stack:
            u = stack.pop()
            piece += int(c.pop[u])
            for v in c.near[u]:
                if may[v] and not seen[v]:
                    seen[v] = True
                    stack.append(v)
        if len(start):
            return bool(seen[start].all()) and piece >= lo
        if piece >= lo:
            return True
    return False


class _TooLong(Exception):
    pass


def labellings(c: Cells, k: int, q: int, lo: int, hi: int, cap: int | None, steps: int, pool: bool = False, pinned: dict | None = None) -> Iterator[np.ndarray]:
    """Labels of cells (a district, the q first safe, or SHARED) that pass all tests, those that share no cell early.

    pool: the districts that needn't be safe are one, in as many pieces as it likes. pinned: labels of some cells.
    """
    n = len(c.cells)
    names = q + 1 if pool and q < k else k
    label = np.full(n, OPEN)
    left = steps

    def size(j: int) -> tuple[int, int]:
        return ((k - q) * lo, (k - q) * hi) if pool and j == q and q < k else (lo, hi)

    def passes() -> bool:
        open_ = label < 0
        room = int(c.pop[open_].sum())
        whole = [int(c.pop[label == j].sum()) for j in range(names)]
        least = [size(j) for j in range(names)]
        if any(p > b or p + room < a for p, (a, b) in zip(whole, least)) or sum(max(a - p, 0) for p, (a, _) in zip(whole, least)) > room:
            return False
        if cap is not None:
            split = 0
            for county in set(c.county[label != OPEN].tolist()):
                here = label[c.county == county]
                met = len(set(here[here >= 0].tolist()))
                split += max(met, 2 if (here == SHARED).any() else met, 1) - 1
            if split > cap:
                return False
        for j in range(names):
            if not (pool and j == q and q < k) and not _joined(c, (label == j) | open_, label == j, lo):
                return False
            if j < q:
                for w in range(len(c.masses)):
                    more = c.best_mass(w, open_, lo - whole[j], hi - whole[j])
                    if more is None or int(c.total[w][label == j].sum()) + more < 0:
                        return False
        if q:
            safe = sum(whole[:q])
            for w in range(len(c.masses)):
                more = c.best_mass(w, open_, q * lo - safe, q * hi - safe)
                if more is None or int(c.total[w][(label >= 0) & (label < q)].sum()) + more < 0:
                    return False
        return True

    def place(i: int) -> Iterator[np.ndarray]:
        nonlocal left
        if i == n:
            yield label.copy()
            return
        u = c.order[i]
        used = set(label[label >= 0].tolist())
        if pinned is not None and u in pinned:
            options = [pinned[u]]
        else:
            # Names within the safe ones, and within the others, are given in order of first use.
            fresh = [next((j for j in range(a, z) if j not in used), None) for a, z in ((0, min(q, names)), (q, names))] if pinned is None else []
            beside = {int(label[v]) for v in c.near[u] if label[v] >= 0}
            options = sorted(used, key=lambda j: (j not in beside, j)) + [j for j in fresh if j is not None] if pinned is None else list(range(names))
            if not c.single[u]:
                options.append(SHARED)
        for j in options:
            left -= 1
            if left < 0:
                raise _TooLong
            label[u] = j
            if passes():
                yield from place(i + 1)
            label[u] = OPEN

    if passes():
        yield from place(0)


@dataclass
class Answer:
    status: str  # feasible, infeasible or unknown
    plan: np.ndarray | None = None
    cells: int = 0
    rounds: int = 0


def checked(g: S.Local, plan: np.ndarray, k: int, q: int, regime: Regime) -> bool:
    """Whether a plan holds all rules of the regime and has q safe districts; straight from the atoms."""
    lo, hi = S.window(g, k, regime.eps)
    sets = [set(np.flatnonzero(plan == j).tolist()) for j in range(k)]
    if not all(x and lo <= int(g.pop[sorted(x)].sum()) <= hi and len(S.parts(g, x)) == 1 for x in sets):
        return False
    if regime.cap is not None and S.splits(g, plan) > regime.cap:
        return False
    return sum(m >= Fraction(*regime.m) for m in S.margins(g, plan, k)) >= q


def decide(g: S.Local, at: np.ndarray, k: int, q: int, regime: Regime, steps: int = MOST_STEPS, pool_only: bool = False, pinned: dict | None = None) -> Answer:
    """Whether there is a plan with q districts of margin m at least.

    First the relaxation whose other districts are one pool is refined as long as it shares cells (pool_only stops
    there: it proves that there is no plan, or leaves it open), then the full one. pinned: districts of some atoms.
    """
    lo, hi = S.window(g, k, regime.eps)
    cells, rounds = first_cells(g), 0
    if pinned:
        cells = [np.array([u]) for u in sorted(pinned)] + [p for c in cells if len(p := np.array([u for u in c if u not in pinned]))]
    pool = pinned is None and 0 < q < k
    if pool_only and not pool:
        return Answer("unknown")
    while rounds < MOST_CUTS:
        rounds += 1
        c = Cells(g, cells, mass(g, Fraction(*regime.m)))
        fixed = None if pinned is None else {int(c.of[u]): j for u, j in pinned.items()}
        best = None
        try:
            for label in labellings(c, k, q, lo, hi, regime.cap, steps, pool, fixed):
                if (label == SHARED).any():
                    best = label if best is None else best
                    break
                if pool:
                    best = label
                    break
                plan = label[c.of]
                if checked(g, plan, k, q, regime):
                    return Answer("feasible", plan, len(cells), rounds)
            else:
                if best is None:
                    return Answer("infeasible", None, len(cells), rounds)
        except _TooLong:
            if pool and not pool_only:
                pool = False
                continue
            return Answer("unknown", None, len(cells), rounds)
        shared = np.flatnonzero(best == SHARED)
        if not len(shared):
            if pool_only:
                return Answer("unknown", None, len(cells), rounds)
            pool = False
            continue
        cells = [x for i, y in enumerate(cells) for x in (halves(g, y, at) if i in set(shared.tolist()) else [y])]
    return Answer("unknown", None, len(cells), rounds)


def places(inst: Instance) -> np.ndarray:
    return inst.atom.select("atom_id", "x", "y").orderBy("atom_id").limit(S.MOST_ATOMS).select("x", "y").toPandas().fillna(0.0).to_numpy(float)


ASKED = "job int, q int, i int, n long, d long"
ANSWERED = "job int, q int, i int, n long, d long, status string, seconds double, iters int, cells int, plan array<int>, achieved_n long, achieved_d long"


def answers(inst: Instance, k: int, regimes: list[Regime], asked: DataFrame, steps: int = MOST_STEPS) -> DataFrame:
    """The answers to questions (job: a regime's number, q, i, margin n / d), a task each, with the plan and its q-th margin."""
    ship(inst.atom.sparkSession)
    held, at = [S.local(inst, r) for r in regimes], places(inst)

    def run(batches):
        import time

        for b in batches:
            rows = []
            for job, q, i, n, d in b[["job", "q", "i", "n", "d"]].itertuples(index=False):
                r, g, start = regimes[job], held[job], time.time()
                a = decide(g, at, k, int(q), Regime(r.party, (int(n), int(d)), r.eps, r.contests, r.cap), steps)
                m = sorted(S.margins(g, a.plan, k), reverse=True)[max(int(q), 1) - 1] if a.plan is not None else None
                rows.append((job, q, i, n, d, a.status, time.time() - start, a.rounds, a.cells, None if a.plan is None else a.plan.tolist(), m.numerator if m is not None else None, m.denominator if m is not None else None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWERED.split(", ")])
            yield out.astype({"achieved_n": "Int64", "achieved_d": "Int64", "plan": object})

    return asked.repartition(max(1, asked.count())).mapInPandas(run, ANSWERED)


@dataclass
class Bracket:
    """One job's q: feasible at lo (-1: nothing known), infeasible at hi, in steps of the grid; margins of plans are exact."""

    lo: int
    hi: int
    unknown: list
    best: Fraction | None = None

    def next(self, most_unknown: int) -> int | None:
        """The grid point to ask about: the middle, or where that is unknown the middle of the points beside it, left and right in turn."""
        if self.hi - self.lo <= 1 or len(self.unknown) >= most_unknown:
            return None
        mid = 0 if self.lo < 0 else (self.lo + self.hi) // 2
        if mid not in self.unknown:
            return mid
        sides = [x for x in ([i for i in range(self.lo + 1, mid) if i not in self.unknown], [i for i in range(mid + 1, self.hi) if i not in self.unknown]) if x]
        if self.lo < 0 or not sides:
            return None
        side = sides[len(self.unknown) % len(sides)]
        return side[len(side) // 2]


def brackets(inst: Instance, k: int, regimes: list[Regime], grid: int = 200, most_unknown: int = 3, steps: int = MOST_STEPS, finer: int = 1) -> tuple[list, list]:
    """For each regime {q: Bracket} (None where it has no plan at all, 'unknown' where that is open), and all answers.

    All jobs and q go on together: a round is one Spark job that asks each open bracket's next question. A plan settles
    all margins up to its own; what is infeasible for q is so for q + 1. finer: the grid is then divided for brackets that
    are settled, and searched again between their ends.
    """
    spark = inst.atom.sparkSession
    top = grid // 2 + 1
    log: list = []

    def ask(rows: list) -> list:
        got = [tuple(r) for r in answers(inst, k, regimes, spark.createDataFrame(rows, ASKED), steps).collect()]  # a row for each open bracket
        log.extend(got)
        return got

    state: list = [None] * len(regimes)
    for job, _, _, _, _, status, *_ in ask([(j, 0, 0, -1, 2) for j in range(len(regimes))]):
        state[job] = {q: Bracket(-1, top, []) for q in range(1, k + 1)} if status == "feasible" else None if status == "infeasible" else "unknown"
    every = [s for s in state if isinstance(s, dict)]
    for fine in dict.fromkeys((1, finer)):
        for s in every if fine > 1 else []:
            for b in s.values():
                if not b.unknown and b.best is not None:
                    b.lo, b.hi = int(b.best * grid * fine), b.hi * fine
                else:
                    b.lo, b.hi, b.unknown = b.lo * fine if b.lo >= 0 else -1, b.hi * fine, [i * fine for i in b.unknown] + [None] * most_unknown
        while rows := [(j, q, i, i, grid * fine) for j, s in enumerate(state) if isinstance(s, dict) for q, b in s.items() if (i := b.next(most_unknown)) is not None]:
            for job, q, i, _, _, status, _, _, _, _, n, d in sorted(ask(rows), key=lambda r: r[:2]):
                b = state[job][q]
                if status == "feasible":
                    m = Fraction(n, d)
                    b.best = m if b.best is None else max(b.best, m)
                    b.lo = max(b.lo, i, min(int(m * grid * fine), b.hi - 1))
                elif status == "infeasible":
                    b.hi = min(b.hi, i)
                else:
                    b.unknown.append(i)
            for s in every:
                for q in range(2, k + 1):
                    s[q].hi = min(s[q].hi, max(s[q - 1].hi, s[q].lo + 1))
    return state, log


def run_documents(inst: Instance, name: str, k: int, regimes: list[Regime], grid: int = 200, steps: int = MOST_STEPS, finer: int = 1) -> DataFrame:
    """One run document a regime (state, party, job, seconds, spectrum, records), as sources.runs reads and writes them."""
    state, log = brackets(inst, k, regimes, grid, steps=steps, finer=finer)
    unit, top = grid * finer, (grid // 2 + 1) * finer
    docs = []
    for j, (r, s) in enumerate(zip(regimes, state)):
        eps = str(Fraction(*r.eps))
        per = {"regime": "feasible" if isinstance(s, dict) else "infeasible" if s is None else "unknown"}
        for q, b in (s or {}).items() if isinstance(s, dict) else ():
            per[str(q)] = json.dumps({
                "lo": b.lo, "hi": b.hi, "unknown": [i for i in b.unknown if i is not None], "best_margin": None if b.best is None else str(b.best),
                "lo_m": str(Fraction(b.lo, unit)) if b.lo >= 0 else None, "hi_m": str(Fraction(b.hi, unit)) if b.hi < top else None,
            })
        records = [
            (name, r.party, r.cap, eps, list(r.contests), q, str(Fraction(n, d)) if q else "0", status, seconds, iters, cells, str(Fraction(an, ad)) if an is not None and q else None, plan_hash(plan) if plan else None, None)
            for job, q, _, n, d, status, seconds, iters, cells, plan, an, ad in log if job == j
        ]
        docs.append((name, r.party, f"{name}_{r.party}_cap{r.cap}_eps{eps.replace('/', '-')}_{'+'.join(r.contests)}", sum(x[8] for x in records), per, records))
    return inst.atom.sparkSession.createDataFrame(docs, f"state string, party string, {RUN_DOC}")
