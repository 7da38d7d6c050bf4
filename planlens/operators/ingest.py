"""From blocks to atoms: contests from column names, counties, populations, missing and straddling atoms, points in polygons."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.operators.graphs import _cut as cut
from planlens.shipping import ship

# The form of a vote column (year and kind, office, party, name) and the offices that aren't statewide partisan contests.
VOTE_COLUMN = r"^G20([A-Z]{3})([A-Z])([A-Za-z0-9]{3})$"
SKIPPED_OFFICES = ("SBE", "SSC", "SAC", "SCC", "COU", "UBR", "PSC", "DEL")


def contests(columns: DataFrame) -> DataFrame:
    """office, d_column, r_column for offices with just one column of each party; columns: name."""
    x = columns.select("name", F.regexp_extract("name", VOTE_COLUMN, 1).alias("office"), F.regexp_extract("name", VOTE_COLUMN, 2).alias("party"))
    x = x.where((F.col("office") != "") & ~F.col("office").startswith("H") & ~F.col("office").isin(*SKIPPED_OFFICES))
    one = lambda p: F.max(F.when(F.col("party") == p, F.col("name")))
    n = lambda p: F.count_if(F.col("party") == p)
    got = x.groupBy("office").agg(n("D").alias("nd"), n("R").alias("nr"), one("D").alias("d_column"), one("R").alias("r_column"))
    return got.where("nd = 1 and nr = 1").select("office", "d_column", "r_column")


def count_column(name: str):
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def county_code(name: str):
    """Three digits."""
    return F.lpad(F.col(name).cast("string"), 3, "0")


def district_codes(df: DataFrame, name: str) -> DataFrame:
    """Rows whose district code is a number."""
    return df.where(F.col(name).rlike("^[0-9]+$"))


def atom_population(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """atom_id, pop: blocks' (atom_id, pop) sums; 0 for atoms without blocks."""
    got = blocks.groupBy("atom_id").agg(F.sum("pop").alias("pop"))
    return atoms.select("atom_id").join(got, "atom_id", "left").select("atom_id", F.coalesce("pop", F.lit(0)).cast("bigint").alias("pop"))


def same_total(a: DataFrame, b: DataFrame) -> DataFrame:
    """same: whether two tables' pop have one sum."""
    s = lambda d, n: d.agg(F.coalesce(F.sum("pop"), F.lit(0)).alias(n))
    return s(a, "a").join(s(b, "b")).select((F.col("a") == F.col("b")).alias("same"))


def plurality(blocks: DataFrame, of: str) -> DataFrame:
    """atom_id and the value of `of` with most population among its blocks; ties fall to the least value."""
    sums = blocks.groupBy("atom_id", of).agg(F.sum("pop").alias("pop"))
    return sums.groupBy("atom_id").agg(F.min(F.struct((-F.col("pop")).alias("p"), F.col(of).alias("v"))).alias("m")).select("atom_id", F.col("m.v").alias(of))


def straddling(blocks: DataFrame, of: str = "county") -> DataFrame:
    """atom_id of atoms whose blocks lie in several counties."""
    return blocks.groupBy("atom_id").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo != hi").select("atom_id")


def disagreeing(found: DataFrame, declared: DataFrame, of: str = "county") -> DataFrame:
    """atoms, disagree: atoms in both tables (atom_id, of), and how many have unlike values; a null is unlike any value."""
    both = found.join(declared.select("atom_id", F.col(of).alias("_declared")), "atom_id")
    return both.agg(F.count("*").alias("atoms"), F.count_if(~F.col(of).eqNullSafe(F.col("_declared"))).alias("disagree"))


def off_plurality(blocks: DataFrame, of: str) -> DataFrame:
    """mass: population outside its atom's plurality value."""
    sums = blocks.groupBy("atom_id", of).agg(F.sum("pop").alias("pop")).groupBy("atom_id").agg(F.sum("pop").alias("all"), F.max("pop").alias("most"))
    return sums.agg(F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("mass"))


def nearest(left: DataFrame, right: DataFrame, width: float, on: str = "atom_id") -> DataFrame:
    """For each left point (on, x, y) the nearest right point (r_id, x, y), ties to the least r_id; bounded grid rings, no cross join.

    Points meet within cells of a grid; those whose best lies within the cell width are settled, the others go on with
    twice the width, until every point is settled. The first width is at most that at which a cell holds one right point
    on average. Null only for points without a place, or where there is no right point with one.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    r = right.where(placed).select("r_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    kind = r.schema["r_id"].dataType
    box = r.agg(F.count("*").alias("n"), F.greatest(F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")).alias("side")).first()
    out = left.where(~placed if box.n else F.lit(True)).select(on, F.lit(None).cast(kind).alias("r_id"))
    rest = left.where(placed).select(on, "x", "y")
    if not box.n or rest.isEmpty():
        return out
    if box.side:
        width = min(width, box.side / math.sqrt(box.n))
    while True:
        near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
        a = rest.withColumn("di", near).withColumn("dj", near)
        a = a.select(on, "x", "y", (F.floor(F.col("x") / width) + F.col("di")).alias("i"), (F.floor(F.col("y") / width) + F.col("dj")).alias("j"))
        b = r.select("*", F.floor(F.col("rx") / width).alias("i"), F.floor(F.col("ry") / width).alias("j"))
        d = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
        found = a.join(b, ["i", "j"]).groupBy(on).agg(F.min(F.struct(d.alias("d"), F.col("r_id"))).alias("m")).where(F.col("m.d") <= width * width)
        found = cut(found.select(on, F.col("m.r_id").alias("r_id")))
        out = out.unionByName(found)
        rest = cut(rest.join(found, on, "left_anti"))
        if rest.isEmpty():
            return out
        width *= 2


def filled(atoms: DataFrame, covered: DataFrame, width: float = 1.0) -> DataFrame:
    """atom_id, county for all atoms: from covered (atom_id, county); else the atom's own known county; else its nearest covered atom's."""
    a = atoms.select("atom_id", "x", "y", F.col("county").alias("own"))
    missing = a.join(covered, "atom_id", "left_anti")
    alone = missing.where("own is null")
    points = covered.join(a.select("atom_id", "x", "y"), "atom_id").select(F.col("atom_id").alias("r_id"), "x", "y")
    near = nearest(alone, points, width).join(covered.select(F.col("atom_id").alias("r_id"), "county"), "r_id").select("atom_id", "county")
    return covered.select("atom_id", "county").unionByName(missing.where("own is not null").select("atom_id", F.col("own").alias("county"))).unionByName(near)


def _inside(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd test of points against the corners of one or several rings, so that holes and separate parts count."""
    x1, y1 = (np.concatenate([r[:, i] for r in rings]) for i in (0, 1))
    x2, y2 = (np.concatenate([np.roll(r[:, i], -1) for r in rings]) for i in (0, 1))
    over = (y1[None] > y[:, None]) != (y2[None] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1)[None] * (y[:, None] - y1[None]) / (y2 - y1)[None] + x1[None]
    return (over & (x[:, None] < at)).sum(axis=1) % 2 == 1


def _rings(polygons: DataFrame):
    return F.col("rings") if "rings" in polygons.columns else F.array("ring")


def within(points: DataFrame, polygons: DataFrame, width: float) -> DataFrame:
    """id, poly_id: the least polygon that holds each point (null if none).

    polygons: poly_id and ring array<struct<x,y>>, or rings, an array of those, for polygons with holes or several parts.

    Points and polygons meet in the grid cells that a polygon's box covers; the exact test runs on those pairs.
    """
    ship(points.sparkSession)
    rings = polygons.select("poly_id", _rings(polygons).alias("rings")).withColumn("all", F.flatten("rings"))
    box = rings.select("poly_id", "rings", F.array_min("all.x").alias("x0"), F.array_max("all.x").alias("x1"), F.array_min("all.y").alias("y0"), F.array_max("all.y").alias("y1"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    cover = box.withColumn("i", cells("x0", "x1")).withColumn("j", cells("y0", "y1"))
    p = points.select("id", "x", "y", F.floor(F.col("x") / width).alias("i"), F.floor(F.col("y") / width).alias("j"))
    pairs = p.join(cover, ["i", "j"]).where("x between x0 and x1 and y between y0 and y1").select("id", "x", "y", "poly_id", "rings")

    def test(batches):
        for b in batches:
            keep = []
            for _, g in b.groupby("poly_id"):
                rings = [np.array([(q["x"], q["y"]) for q in r]) for r in g["rings"].iloc[0] if len(r)]
                keep.append(g[_inside(g["x"].to_numpy(), g["y"].to_numpy(), rings)][["id", "poly_id"]])
            yield pd.concat(keep) if keep else b[["id", "poly_id"]].iloc[:0]

    kind = f"id {points.schema['id'].dataType.simpleString()}, poly_id {polygons.schema['poly_id'].dataType.simpleString()}"
    hit = pairs.mapInPandas(test, kind).groupBy("id").agg(F.min("poly_id").alias("poly_id"))
    return points.select("id").join(hit, "id", "left")


def nearest_polygon(points: DataFrame, polygons: DataFrame, width: float) -> DataFrame:
    """id, poly_id: the polygon (poly_id, ring or rings) whose border runs nearest each point (id, x, y), ties to the least poly_id.

    Edges are cut into pieces no longer than the cell width and meet the points in the cells of a grid; points whose best
    lies within a cell width are settled, the others go on with twice the width. Null where the point has no place or
    there is no polygon.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    edge = F.explode(F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.element_at("ring", (i + 1) % F.size("ring") + 1).alias("b"))))
    e = polygons.select("poly_id", F.explode(_rings(polygons)).alias("ring")).select("poly_id", edge.alias("e")).select("poly_id", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    e = e.withColumn("len", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
    longest = e.agg(F.max("len")).first()[0]
    out = points.where(~placed if longest is not None else F.lit(True)).select("id", F.lit(None).cast(polygons.schema["poly_id"].dataType).alias("poly_id"))
    rest = points.where(placed).select("id", "x", "y")
    if longest is None or rest.isEmpty():
        return out
    while True:
        cell = F.lit(width)
        m = F.greatest(F.ceil(F.col("len") / cell), F.lit(1))
        s = e.withColumn("m", m).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))
        on = lambda c, t: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t / F.col("m")
        s = s.select("poly_id", *[on(c, F.col("i") + k).alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
        reach = lambda c: F.explode(F.sequence(F.floor(F.least(f"{c}0", f"{c}1") / cell) - 1, F.floor(F.greatest(f"{c}0", f"{c}1") / cell) + 1))
        s = s.withColumn("ci", reach("x")).withColumn("cj", reach("y"))
        p = rest.select("*", F.floor(F.col("x") / cell).alias("ci"), F.floor(F.col("y") / cell).alias("cj"))
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        sq = dx * dx + dy * dy
        t = F.when(sq == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / sq)))
        ex, ey = F.col("x") - (F.col("x0") + t * dx), F.col("y") - (F.col("y0") + t * dy)
        got = p.join(s, ["ci", "cj"]).groupBy("id").agg(F.min(F.struct((ex * ex + ey * ey).alias("d"), "poly_id")).alias("m"))
        got = cut(got.where(F.col("m.d") <= width * width).select("id", F.col("m.poly_id").alias("poly_id")))
        out = out.unionByName(got)
        rest = cut(rest.join(got, "id", "left_anti"))
        if rest.isEmpty():
            return out
        width *= 2


def in_districts(blocks: DataFrame, polygons: DataFrame, width: float) -> DataFrame:
    """id, poly_id: each block's polygon, or the nearest one where no polygon holds it. blocks: id, x, y."""
    inside = cut(within(blocks.select("id", "x", "y"), polygons, width))
    lone = blocks.select("id", "x", "y").join(inside.where("poly_id is null").select("id"), "id")
    return inside.where("poly_id is not null").unionByName(nearest_polygon(lone, polygons, width))


def enacted_plan(blocks: DataFrame, atoms: DataFrame, polygons: DataFrame, width: float) -> DataFrame:
    """atom_id, poly_id: the polygon with most of each atom's population (ties to the least), or the nearest to an atom without any.

    blocks: id, atom_id, pop, x, y; atoms: atom_id, x, y.
    """
    d = blocks.join(in_districts(blocks, polygons, width), "id").where("poly_id is not null and pop > 0")
    most = cut(plurality(d.select("atom_id", "poly_id", "pop"), "poly_id"))
    empty = atoms.select(F.col("atom_id").alias("id"), "x", "y").join(most.select(F.col("atom_id").alias("id")), "id", "left_anti")
    return most.unionByName(nearest_polygon(empty, polygons, width).withColumnRenamed("id", "atom_id"))


def adjacency(polygons: DataFrame, width: float, least: float) -> DataFrame:
    """u < v: polygons (poly_id, ring) whose rings run along each other, at most width apart, for at least this length in all.

    Corners needn't meet. Edges are cut into pieces of a grid cell's length, so that a piece lies in a few cells; pieces
    meet in cells, and where both ends of one lie near the line of the other, the length of their overlap counts.
    """
    n = F.size("ring")
    edge = F.posexplode(F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.element_at("ring", (i + 1) % n + 1).alias("b"))))
    e = polygons.select("poly_id", edge.alias("nth", "e")).select("poly_id", "nth", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    e = e.withColumn("len", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).where("len > 0")
    cell = F.lit(max(e.agg(F.avg("len")).first()[0] or 0.0, 4 * width, 1e-300))
    e = e.withColumn("m", F.ceil(F.col("len") / cell)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    on = lambda c, t: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t / F.col("m")
    p = e.select("poly_id", F.struct("nth", "i").alias("piece"), *[on(c, F.col("i") + k).alias(f"{c}{k}") for k in (0, 1) for c in "xy"], (F.col("len") / F.col("m")).alias("len"))
    reach = lambda c: F.explode(F.sequence(F.floor((F.least(f"{c}0", f"{c}1") - width) / cell), F.floor((F.greatest(f"{c}0", f"{c}1") + width) / cell)))
    p = p.withColumn("ci", reach("x")).withColumn("cj", reach("y"))
    q = p.select("ci", "cj", *[F.col(c).alias(f"v_{c}") for c in ("poly_id", "piece", "x0", "y0", "x1", "y1")])
    both = p.join(q, ["ci", "cj"]).where("poly_id < v_poly_id")
    dx, dy = (F.col("x1") - F.col("x0")) / F.col("len"), (F.col("y1") - F.col("y0")) / F.col("len")
    along = lambda k: (F.col(f"v_x{k}") - F.col("x0")) * dx + (F.col(f"v_y{k}") - F.col("y0")) * dy
    off = lambda k: F.abs((F.col(f"v_y{k}") - F.col("y0")) * dx - (F.col(f"v_x{k}") - F.col("x0")) * dy)
    overlap = F.least(F.col("len"), F.greatest(along(0), along(1))) - F.greatest(F.lit(0.0), F.least(along(0), along(1)))
    both = both.where((off(0) <= width) & (off(1) <= width)).select(F.col("poly_id").alias("u"), F.col("v_poly_id").alias("v"), "piece", "v_piece", overlap.alias("o")).where("o > 0")
    # Two pieces may meet in several cells.
    return both.distinct().groupBy("u", "v").agg(F.sum("o").alias("o")).where(F.col("o") >= least * (1 - 1e-9)).select("u", "v")


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def vote_columns(names: list[str]) -> list[str]:
    """Names that have the form of a vote column."""
    return [n for n in names if re.match(VOTE_COLUMN, n)]


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by a seeded hash of their key; the same for a seed, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), key).limit(n)
