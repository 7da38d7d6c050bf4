"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources form a pattern; a pattern supplies
its tokens once at cost 1, a second time at cost 3, a third time at cost 5 and so on (convex, so that the flow spreads
repeats evenly), and a source asks for its target. The flow says how many tokens each pattern gives to each source.
Which documents of a pattern are repeated once more than the others is then drawn by a seeded hash: the last copies go
to the documents of lowest hash. The place where they end is found by sums over hash ranges, so no task sorts a whole
pattern.

Only patterns (as many as there are sets of sources in use) reach the driver, never documents.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own and the last in
order; documents of no source (an empty set) are taken 0 times; repeated rows are drawn one by one (equal rows
get equal copies, so they may be taken or left together); an empty table gives no rows; extra columns are ignored;
ties of the hash fall to the smaller id.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from planlens.llm.common import WORD, text_of, written

#: Hash ranges in a pattern, and the most patterns that one flow is solved for.
RANGES, MOST_PATTERNS = 4096, 100_000
#: Rounds in which a single further document is looked for that closes the gap to the target.
CLOSING = 3


def targets_of(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Shares of all sizes by weight; a target stops at most times its source's size, the excess goes by weight to the others."""
    total, out, open_ = sum(sizes.values()), {}, {s for s in sizes if weights[s] > 0}
    left = Fraction(total)
    out = {s: Fraction(0) for s in sizes}
    while open_:
        w = sum(Fraction(weights[s]) for s in open_)
        over = {s for s in open_ if left * Fraction(weights[s]) / w > most * sizes[s]}
        if not over:
            for s in open_:
                out[s] = left * Fraction(weights[s]) / w
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def flow(supply: dict, needs: dict, most: int = 3) -> dict:
    """{(pattern, source): tokens} of least cost that gives each source its need, as far as supplies reach.

    supply: tokens of each pattern (a tuple of sources); a pattern gives them up to most times, the k-th time at cost
    2k - 1. Only the arcs from the start have costs, so a path costs as much as its first arc, and successive shortest
    paths are a greatest flow over first times, then one over second times on top of it, and so on. Each is found by
    blocking flows over shortest paths (pattern, source, pattern that gives to it, another source, ...).
    """
    patterns = [p for p in sorted(supply, key=repr) if supply[p] > 0]
    to = [[x for x in dict.fromkeys(p) if x in needs] for p in patterns]
    need = dict(needs)
    given: dict = {x: {} for x in needs}  # tokens by pattern

    def give(p: int, x, n: int) -> None:
        given[x][p] = given[x].get(p, 0) + n

    for _ in range(most):
        left = [supply[p] for p in patterns]
        for p, sources in enumerate(to):
            for x in sources:
                if (n := min(left[p], need[x])) > 0:
                    give(p, x, n)
                    left[p] -= n
                    need[x] -= n
        while True:
            # Distances from patterns with tokens left; sources are known by name, patterns by number.
            at = {("p", p): 0 for p in range(len(patterns)) if left[p] > 0}
            front, found = list(at), False
            while front and not found:
                nxt = []
                for kind, u in front:
                    d = at[kind, u] + 1
                    for v in [("s", x) for x in to[u]] if kind == "p" else [("p", q) for q, n in given[u].items() if n > 0]:
                        if v not in at:
                            at[v] = d
                            nxt.append(v)
                            found = found or (v[0] == "s" and need[v[1]] > 0)
                front = nxt
            if not found:
                break
            rest: dict = {}
            for p in [p for p in range(len(patterns)) if left[p] > 0]:
                path = [("p", p)]
                while path:
                    kind, u = path[-1]
                    if kind == "s" and need[u] > 0:
                        n = min([left[p], need[u]] + [given[path[i][1]].get(path[i + 1][1], 0) for i in range(1, len(path) - 1, 2)])
                        for i in range(0, len(path), 2):
                            give(path[i][1], path[i + 1][1], n)
                        for i in range(1, len(path) - 1, 2):
                            give(path[i + 1][1], path[i][1], -n)
                        left[p] -= n
                        need[u] -= n
                        if left[p] == 0:
                            break
                        path = path[:1]
                        continue
                    if (kind, u) not in rest:
                        rest[kind, u] = [("s", x) for x in to[u]] if kind == "p" else [("p", q) for q, n in given[u].items() if n > 0]
                    options = rest[kind, u]
                    while options:
                        v = options[-1]
                        if at.get(v) == at[kind, u] + 1 and (kind == "p" or given[u].get(v[1], 0) > 0):
                            path.append(v)
                            break
                        options.pop()
                    else:
                        path.pop()
                        if path:
                            rest[path[-1]].pop()
    return {(patterns[p], x): n for x, by in given.items() for p, n in by.items() if n > 0}


def _copies(d: DataFrame, patterns: DataFrame) -> DataFrame:
    """d with copies: base for all of a pattern, one more for documents of lowest hash up to the pattern's extra tokens.

    patterns: pattern, base, extra. It is as small as the set of patterns, at most MOST_PATTERNS rows, hence broadcast.
    """
    d = d.join(F.broadcast(patterns), d["pattern"].eqNullSafe(patterns["_pattern"]), "left").drop("_pattern")
    d = d.withColumn("range", F.pmod(F.col("draw"), F.lit(RANGES)).cast("int"))
    sums = d.where("extra > 0").groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    w = W.partitionBy("pattern").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    cut = cut.select(F.col("pattern").alias("_pattern"), F.col("range").alias("_range"), "before")
    # One range of each pattern holds the cut; only its documents are ordered.
    e = d.join(cut, d["pattern"].eqNullSafe(cut["_pattern"]) & (d["range"] == cut["_range"]), "left").drop("_pattern", "_range")
    here = F.when((F.col("before") < F.col("extra")) & (F.col("size") > 0), F.col("before"))
    e = written(e.withColumn("before", here))
    ends = e.where("before is not null").groupBy("pattern").agg(F.max("before").alias("_last")).select(F.col("pattern").alias("_pattern"), "_last")
    e = e.join(F.broadcast(ends), e["pattern"].eqNullSafe(ends["_pattern"]), "left").drop("_pattern")
    at_cut = e.where("before = _last")
    w2 = W.partitionBy("pattern").orderBy("draw", "by", "key").rowsBetween(W.unboundedPreceding, 0)
    upto = at_cut.withColumn("upto", F.col("before") + F.sum("size").over(w2)).where("upto <= extra").select("key", F.lit(True).alias("_in"), "pattern", "size", "before")
    whole = e.where("before < _last")
    # Tokens still missing in each pattern after whole ranges and the cut one.
    got = whole.groupBy("pattern").agg(F.sum("size").alias("g")).unionByName(upto.groupBy("pattern").agg(F.sum("size").alias("g")))
    got = got.groupBy("pattern").agg(F.sum("g").alias("got"))
    p = patterns.where("extra > 0")
    gap = p.join(got, p["_pattern"].eqNullSafe(got["pattern"]), "left").select("_pattern", (F.col("extra") - F.coalesce("got", F.lit(0))).alias("gap"))
    inside = whole.select("key").unionByName(upto.select("key")).withColumn("more", F.lit(1))
    e = written(e.join(inside, "key", "left").withColumn("more", F.coalesce("more", F.lit(0))))
    for _ in range(CLOSING):
        # Of the documents left out, the one that closes most of the gap without passing it by more than it closes.
        left = e.where("extra > 0 and more = 0 and size > 0").join(F.broadcast(gap), e["pattern"].eqNullSafe(gap["_pattern"]))
        fits = F.abs(F.col("size") - F.col("gap"))
        best = left.where(fits < F.col("gap")).groupBy("_pattern").agg(F.min(F.struct(fits.alias("off"), F.col("draw"), F.col("by"), F.col("key").alias("k"), F.col("size").alias("closed"))).alias("b"))
        best = written(best.select(F.col("_pattern").alias("b_pattern"), "b.k", "b.closed"))
        pick = best.select(F.col("k").alias("key"), F.lit(1).alias("_one"))
        e = e.join(F.broadcast(pick), "key", "left").withColumn("more", F.col("more") + F.coalesce("_one", F.lit(0))).drop("_one")
        gap = gap.join(F.broadcast(best), gap["_pattern"].eqNullSafe(best["b_pattern"]), "left").select("_pattern", (F.col("gap") - F.coalesce("closed", F.lit(0))).alias("gap"))
    return e.withColumn("copies", F.coalesce("base", F.lit(0)) + F.col("more")).drop("before", "_last", "more", "range", "base", "extra", "by")


def mix(docs: DataFrame, size: Column, sources: Column, weigh, most: int = 3, seed: int = 17, id_col: str = "doc_id") -> tuple[DataFrame, list]:
    """(rows, shares). rows: id, key, size, pattern and copies for every document; shares: (source, size, target) of each source.

    sources: array<string> of a document's sources, null for the null source inside. weigh(sizes) gives each source's weight.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col), size.cast("long").alias("size"), F.array_sort(F.array_distinct(sources)).alias("pattern"))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col("pattern"), F.col("size"))
    d = d.withColumn("draw", draw).withColumn("by", F.col(id_col)).withColumn("key", F.monotonically_increasing_id())
    d = written(d)  # so that row keys stay as they are
    sums = [(tuple(r.pattern or ()), r.words or 0) for r in d.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()]
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    supply: dict = {}
    for p, n in sums:
        supply[p] = supply.get(p, 0) + n
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = targets_of(sizes, weigh(sizes), most)
    given = flow(supply, {s: round(t) for s, t in target.items()}, most)
    rows = []
    for p, n in supply.items():
        words = sum(given.get((p, s), 0) for s in set(p))
        base = min(most, words // n) if n else 0
        rows.append((list(p), base, words - base * n if base < most else 0))
    schema = T._parse_datatype_string("_pattern array<string>, base int, extra long")
    patterns = spark.createDataFrame(rows, schema)
    shares = [(s, sizes[s], float(target[s])) for s in sizes]
    return _copies(d, patterns), shares


def in_order(sizes: dict) -> list:
    """Sources by code point, null last."""
    return sorted(sizes, key=lambda s: (s is None, s or ""))


def cycle(*weights):
    return lambda sizes: {s: weights[i % len(weights)] for i, s in enumerate(in_order(sizes))}


def _words(col: str = "text") -> Column:
    """Words of a text; counted where white space or the start is followed by a word."""
    return F.regexp_count(text_of(col), F.lit(WORD))


SHARES = "_source string, source_size long, target double"


def _mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    d, shares = mix(docs, _words(), F.array(F.col("source")), cycle(5, 2, 1))
    return d, docs.sparkSession.createDataFrame(shares, T._parse_datatype_string(SHARES))


def op3(docs: DataFrame) -> DataFrame:
    """One source a document; sources weigh 5, 2, 1, repeating, and share all words."""
    d, shares = _mixed(docs)
    d = d.withColumn("source", F.get("pattern", F.lit(0)))
    d = d.join(F.broadcast(shares), d["source"].eqNullSafe(shares["_source"]), "left")
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", F.col("copies").cast("int"))


def mix_texts(docs: DataFrame) -> DataFrame:
    """Sources that overlap: a text belongs to every source that has it, and is drawn once for all of them."""
    source = F.transform(F.collect_set(F.struct(F.col("source").alias("s"))), lambda x: x["s"])
    texts = docs.groupBy(F.sha2(text_of(), 256).alias("print")).agg(F.min("doc_id").alias("doc_id"), F.first(_words()).alias("words"), source.alias("sources"))
    d, shares = mix(texts, F.col("words"), F.col("sources"), cycle(5, 2, 1), id_col="print")
    ids = texts.select(F.col("print").alias("_print"), "doc_id")
    return d.join(ids, F.col("print") == F.col("_print")).select("doc_id", "size", F.col("pattern").alias("sources"), F.col("copies").cast("int"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.lit(sum(t for *_, t in shares)).alias("all_targets"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the columns of docs.

    Documents without words have nothing to take and are left out.
    """
    d, _ = _mixed(docs)
    taken = d.where("copies > 0").select("doc_id", "size", F.get("pattern", F.lit(0)).alias("_source"), "copies")
    taken = taken.groupBy("doc_id", "size", "_source").agg(F.sort_array(F.collect_list("copies"), False).alias("_each"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_source", "_each")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), _words().alias("size"), F.xxhash64("text").alias("tie"))
    on = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & F.col("doc.source").eqNullSafe(F.col("_source"))
    # Rows alike in id, size and source share the copies that the mix gave to rows like them.
    nth = F.row_number().over(W.partitionBy("_id", "_size", "_source").orderBy("tie"))
    found = whole.join(taken, on).withColumn("copies", F.coalesce(F.get("_each", nth - 1), F.lit(0)))
    return found.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("nth")).select("doc.*")
