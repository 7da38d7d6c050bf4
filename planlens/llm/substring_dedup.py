"""Removal of repeated byte strings of SPAN bytes, by suffix arrays of aligned contexts.

1. Anchors. Of all KMER-byte strings in a window of SPAN bytes, those of least hash are anchors. Equal windows have
   equal anchors at equal places, so a window that occurs twice holds an anchor whose string occurs twice.
2. Contexts. Around each occurrence of a repeated anchor, the bytes that a window with this anchor can hold are its
   context. Equal contexts around equal anchors are one row with a count.
3. Suffix arrays. The contexts of an anchor are written as symbols of BLOCK bytes, aligned to the anchor. Suffixes of
   these symbols that agree for SPAN - BLOCK bytes are neighbours in the suffix array (linear grouping, see
   suffix_array); a look at the bytes before and after such a run tells which windows are equal.
4. Each text's repeated windows are joined and removed.

Texts are never shuffled: step 1 writes them to the shared folder, a folder for each partition, and later steps send
the places of anchors and the runs to remove back to the partition that a text lies in.

An anchor with more than HOT occurrences (in a passage that very many texts share) is dealt by context instead, so
that equal contexts meet before they are moved. If it has more than MOST different ones (at the passage's ends), its
windows are halved by their place relative to the anchor, and each half is grouped by the bytes that all its windows
share, until groups are small or a group is one window. So no task holds an unbounded group, and none is cut.

Defined results: null counts as empty; texts under SPAN bytes lose nothing; all occurrences go, the first too; equal
texts of SPAN bytes or more go whole; repeated rows count as occurrences; null ids are carried; an empty table gives
no rows; extra columns are ignored; texts are judged as they came in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planlens.llm.common import opener, shared_dir, ship, small_batches, text_of, written
from planlens.llm.suffix_array import suffix_array

SPAN, KMER, BLOCK = 200, 100, 20
#: Occurrences of an anchor from which it is dealt by context; different contexts of one anchor that a task takes at once;
#: contexts that share a suffix array; bytes hashed together.
HOT, MOST, TOGETHER, AT_ONCE = 512, 16_384, 4096, 1_500_000

_U = np.uint64
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, AT_ONCE + 1), base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _sliding(v: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours, by running values within blocks of w from either side."""
    n = len(v)
    pad = np.concatenate([v, np.full(-n % w, v[-1], v.dtype)]).reshape(-1, w)
    ahead = f.accumulate(pad, axis=1).ravel()
    back = f.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in texts laid end to end (ends: where each ends), and the hashes of their strings."""
    n = len(data)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, n))])
    h = _mix((total[kmer:] - total[:-kmer]) * _power(_INVERSE, n - kmer + 1))
    w = span - kmer + 1
    least = _sliding(h, w, np.minimum)  # for each window of span bytes
    inside = np.zeros(len(least), bool)
    starts = np.concatenate([[0], ends[:-1]])
    # A window is inside its text if it begins no later than span bytes before the text's end.
    step = np.zeros(n + 1, np.int32)
    long = ends - starts >= span
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - span + 1, -1)
    inside = np.cumsum(step)[: len(least)] > 0
    least[~inside] = 0
    around = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
    at = np.flatnonzero(_sliding(around, w, np.maximum) == h)
    return at, h[at].view(np.int64)


def anchors_of_long(data: np.ndarray, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one text of any length: of parts that share all but one byte of a window, so that each window lies in one part."""
    found = []
    for a in range(0, max(len(data) - SPAN + 1, 1), at_once):
        part = data[a : a + at_once + SPAN - 1]
        at, h = anchors(part, np.array([len(part)]))
        found.append((at + a, h))
    at, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def _anchored(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Writes row, id, print, n_bytes, text, places and hashes of anchors below out, a folder (pid=...) for each partition."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            places, hashes, counts, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, "right")) - 1)
                ends = offsets[a + 1 : z + 1] - offsets[a]
                at, h = anchors(data[offsets[a] : offsets[z]], ends) if z > a + 1 else anchors_of_long(data[offsets[a] : offsets[z]])
                of = np.searchsorted(ends, at, "right")
                places.append((at - np.concatenate([[0], ends[:-1]])[of]).astype(np.int32))
                hashes.append(h)
                counts.append(np.bincount(of, minlength=z - a))
                a = z
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (places, hashes)]
            columns = ["row", "id", "print", "n_bytes", "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, columns), *lists], [*columns, "places", "hashes"])

    text = text_of(text_col)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.sha2(text, 256).alias("print"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    d = d.mapInArrow(run, "row long, id long, print string, n_bytes long, text string, places array<int>, hashes array<long>")
    schema = T.StructType([*d.schema.fields, T.StructField("pid", T.IntegerType())])
    _by_pid(d, out)
    return docs.sparkSession.read.schema(schema).parquet(out)


def _pid():
    """The partition that a row number was given in."""
    return F.shiftright("row", 33).cast("int")


def _by_pid(d: DataFrame, out: str) -> None:
    with small_batches(d.sparkSession):
        d.withColumn("pid", _pid()).write.mode("overwrite").option("compression", "zstd").partitionBy("pid").parquet(out)


def _part(at: str, pid: int, columns: list[str], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of one partition's folder; none if it holds nothing."""
    import pyarrow.dataset as ds

    fs, root = opener(at)
    if fs.get_file_info(f"{root}/pid={pid}").type.name == "Directory":
        yield from ds.dataset(f"{root}/pid={pid}", filesystem=fs, format="parquet").to_batches(columns=columns, batch_size=size)


def _table(at: str, pid: int, columns: list[str]) -> pd.DataFrame:
    got = [b.to_pandas() for b in _part(at, pid, columns, 65_536)]
    return pd.concat(got, ignore_index=True) if got else pd.DataFrame(columns=columns)


def _words(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The BLOCK bytes from each place on as numbers of 8 bytes, the first byte lowest."""
    out = []
    for first in range(0, BLOCK, 8):
        x = np.zeros(at.shape, _U)
        for k in range(first, min(first + 8, BLOCK)):
            x |= data[at + k].astype(_U) << _U(8 * (k - first))
        out.append(x)
    return out


def _masks(n: int) -> list[np.uint64]:
    """Numbers of 8 bytes with the first n of BLOCK bytes set."""
    return [_U((1 << (8 * max(0, min(n - first, 8)))) - 1) for first in range(0, BLOCK, 8)]


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): rows sorted by keys, and for each sorted row the number of its distinct key, from 0."""
    order = np.lexsort(keys)
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def repeated_windows(groups: np.ndarray, contexts: list[bytes], before: np.ndarray, many: np.ndarray, span: int = SPAN):
    """(context, window start relative to the anchor) for each window that recurs, among different contexts of a group.

    before: bytes of each context before its anchor; many: contexts that occur more than once by themselves, all of
    whose windows recur (they aren't listed, but count as partners).
    """
    n = np.array([len(c) for c in contexts], np.int64)
    pad = 2 * BLOCK
    size = n + 2 * pad
    data = np.zeros(int(size.sum()), np.uint8)
    origin = np.concatenate([[0], np.cumsum(size)[:-1]]) + pad + before  # of each context's anchor
    first = origin - before
    data[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))] = np.frombuffer(b"".join(contexts), np.uint8)
    # Symbols: whole blocks within the context, counted from the anchor.
    lo, hi = -(before // BLOCK), (n - before) // BLOCK
    count = hi - lo
    of = np.repeat(np.arange(len(n)), count)
    block = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + lo[of]
    order, rank = _numbered(*_words(data, origin[of] + BLOCK * block), block, groups[of])
    symbol = np.empty(len(of), np.int64)
    symbol[order] = rank + 1  # 0 ends a context
    where = np.arange(len(of)) + of
    text = np.zeros(len(of) + len(n), np.int64)
    text[where] = symbol
    sa = suffix_array(text)
    run = span // BLOCK - 1  # whole blocks in a window that isn't aligned
    back = np.full(len(text), -1, np.int64)
    back[where] = np.arange(len(of))
    left = np.full(len(text), 0, np.int64)
    left[where] = hi[of] - block  # symbols to the context's end
    sa = sa[left[sa] >= run]
    if len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.ones(len(sa) - 1, bool)
    for t in range(run):
        same &= text[sa[:-1] + t] == text[sa[1:] + t]
    cls = np.concatenate([[0], np.cumsum(~same)])
    sizes = np.bincount(cls)
    keep = sizes[cls] > 1
    sa, cls = sa[keep], cls[keep]
    sym = back[sa]
    c, j = of[sym], block[sym]
    at = origin[c] + BLOCK * j
    pre, post = _words(data, at - BLOCK), _words(data, at + BLOCK * run)
    found_c, found_w = [], []
    for k in range(BLOCK):  # bytes of the window before its first whole block
        ok = (BLOCK * j - k >= -before[c]) & (BLOCK * (j + run) + BLOCK - k <= n[c] - before[c])
        if not ok.any():
            continue
        # The first BLOCK - k bytes after and, in their places, the last k before.
        rest = [((y & m) | (x & ~m))[ok] for x, y, m in zip(pre, post, _masks(BLOCK - k))]
        o, number = _numbered(*rest, cls[ok])
        more = np.bincount(number)[number] > 1
        found_c.append(c[ok][o][more])
        found_w.append((BLOCK * j - k)[ok][o][more])
    if not found_c:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_c, found_w = np.concatenate(found_c), np.concatenate(found_w)
    single = ~many[found_c]
    return found_c[single], found_w[single]


def _runs(starts: np.ndarray, span: int) -> list[dict]:
    """Windows' starts as runs of covered bytes."""
    s = np.unique(starts)
    cut = np.flatnonzero(np.diff(s) > span)
    return [{"s": int(a), "e": int(b) + span} for a, b in zip(s[np.concatenate([[0], cut + 1])], s[np.append(cut, len(s) - 1)])]


def solve(key, before, lo, hi, contexts: list[bytes], n) -> dict[int, list[dict]]:
    """Runs of repeated windows, relative to the anchor, for the contexts of whole groups; lo and hi: bytes that a window may have before the anchor."""
    before, lo, hi, many = (np.asarray(x, np.int64) for x in (before, lo, hi, n))
    many = many > 1
    _, groups, sizes = np.unique(np.asarray(key, np.int64), return_inverse=True, return_counts=True)
    runs: dict[int, list] = {}
    for i in np.flatnonzero(many):  # occurs again as a whole: each of its windows does
        a, z = -min(before[i], hi[i]), min(len(contexts[i]) - before[i] - SPAN, -lo[i])
        if a <= z:
            runs[int(i)] = [{"s": int(a), "e": int(z) + SPAN}]
    # Groups whose contexts all occur again as wholes have nothing left to find.
    open_ = np.bincount(groups, ~many) > 0
    pick = np.flatnonzero((sizes[groups] > 1) & open_[groups])
    if len(pick):
        c, w = repeated_windows(groups[pick], [contexts[i] for i in pick], before[pick], many[pick])
        c = pick[c]
        ok = (-w >= lo[c]) & (-w <= hi[c])
        c, w = c[ok], w[ok]
        o = np.argsort(c, kind="stable")
        c, w = c[o], w[o]
        edges = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        for a, z in zip(edges, np.append(edges[1:], len(c))):
            runs[int(c[a])] = _runs(w[a:z], SPAN)
    return runs


def _whole_groups(batches):
    """Batches, sorted by key, cut anew so that no key lies in two of them."""
    held = None
    for b in batches:
        held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
        while len(held) > TOGETHER:
            key = held["key"].to_numpy()
            z = int(np.searchsorted(key, key[TOGETHER], "left")) or int(np.searchsorted(key, key[TOGETHER], "right"))
            if z >= len(key):
                break
            yield held.iloc[:z].reset_index(drop=True)
            held = held.iloc[z:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


RESULT = "key long, cid string, runs array<struct<s:int,e:int>>"


def _name(bytes_: str = "bytes"):
    """Names a context within its group: its bytes and where its anchor lies in them."""
    return F.md5(F.concat(bytes_, F.col("before").cast("string").cast("binary")))


def _resolve_small(contexts: DataFrame) -> DataFrame:
    """(key, cid, runs) for contexts (key, cid, before, lo, hi, bytes, n) in groups of at most MOST."""

    def run(batches):
        for b in _whole_groups(batches):
            runs = solve(b["key"], b["before"], b["lo"], b["hi"], list(b["bytes"]), b["n"])
            at = sorted(runs)
            yield pd.DataFrame({"key": b["key"].to_numpy()[at], "cid": b["cid"].to_numpy()[at], "runs": pd.Series([runs[i] for i in at], dtype=object)})

    return contexts.repartition(_parts(contexts.sparkSession), "key").sortWithinPartitions("key").mapInPandas(run, RESULT)


def _resolve(contexts: DataFrame, depth: int = 0) -> DataFrame:
    """Runs of every context that has any. contexts is written already, one row for each (key, cid)."""
    sizes = contexts.groupBy("key").agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > MOST).select("key")) if depth < 9 else None
    if hot is None or hot.isEmpty():
        return written(_resolve_small(contexts))
    small = _resolve_small(contexts.join(hot, "key", "left_anti"))
    large = contexts.join(hot, "key", "left_semi")
    # Halve the range of windows; a half is grouped by the bytes that all its windows share.
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
    h = large.select("key", "cid", "before", "bytes", "n", F.explode(halves).alias("r")).where("r.lo <= r.hi").select("key", "cid", "before", "bytes", "n", "r.lo", "r.hi")
    after = F.octet_length("bytes") - F.col("before")
    h = h.where((F.col("before") >= F.col("lo")) & (after >= F.lit(SPAN) - F.col("hi")))
    left = F.least("before", "hi")
    part = F.col("bytes").substr(F.col("before") - left + 1, left + F.least(after, F.lit(SPAN) - F.col("lo")))
    core = F.col("bytes").substr(F.col("before") - F.col("lo") + 1, F.col("lo") + F.lit(SPAN) - F.col("hi"))
    h = h.select(F.col("key").alias("up_key"), F.col("cid").alias("up_cid"), F.xxhash64("key", "lo", "hi", core).alias("key"),
                 left.cast("int").alias("before"), "lo", "hi", part.alias("bytes"), "n").withColumn("cid", _name())
    h = written(h)
    below = h.groupBy("key", "cid", "before", "lo", "hi", "bytes").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
    found = _resolve(written(below), depth + 1)
    back = h.select("key", "cid", "up_key", "up_cid").join(found.hint("merge"), ["key", "cid"]).groupBy("up_key", "up_cid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return written(small.unionByName(back.select(F.col("up_key").alias("key"), F.col("up_cid").alias("cid"), "runs")))


CONTEXTS = "key long, hot boolean, before int, bytes binary, n int, rows array<long>, places array<int>"
RUNS = "row long, s int, e int"


def _contexts(spark, rows_at: str, places_at: str, pids: int) -> DataFrame:
    """Contexts of all places, equal ones of a partition together; from the partition's own texts."""
    reach = SPAN - KMER

    def run(batches):
        for b in batches:
            for pid in b["id"]:
                places = _table(places_at, pid, ["row", "place", "key", "hot", "n"]).sort_values("row", kind="stable")
                row, place, key = (places[c].to_numpy(np.int64) for c in ("row", "place", "key"))
                hot, n = places["hot"].to_numpy(bool), places["n"].to_numpy(np.int64)
                found: dict = {}
                for texts in _part(rows_at, pid, ["row", "text"]) if len(row) else ():
                    for r, text in zip(texts.column("row").to_pylist(), texts.column("text")):
                        a, z = np.searchsorted(row, [r, r + 1])
                        if a == z:
                            continue
                        data = text.as_buffer().to_pybytes()
                        for i in range(a, z):
                            p = int(place[i])
                            c = (int(key[i]), min(p, reach), data[max(p - reach, 0) : p + SPAN])
                            if (f := found.get(c)) is None:
                                f = found[c] = [bool(hot[i]), 0, [], []]
                            f[1] += int(n[i])
                            f[2].append(r)
                            f[3].append(p)
                            if len(found) > 100_000:
                                yield _context_rows(found)
                                found = {}
                if found:
                    yield _context_rows(found)

    return spark.range(0, pids, 1, pids).mapInPandas(run, CONTEXTS)


def _context_rows(found: dict) -> pd.DataFrame:
    rows = [(k[0], v[0], k[1], k[2], min(v[1], 2), v[2], v[3]) for k, v in found.items()]
    return pd.DataFrame(rows, columns=["key", "hot", "before", "bytes", "n", "rows", "places"])


def _runs_of(contexts: DataFrame) -> DataFrame:
    """Runs to remove, by row, from contexts in groups of at most HOT occurrences."""
    reach = SPAN - KMER

    def run(batches):
        for b in _whole_groups(batches):
            one: dict = {}
            for k, before, data, n, rows, places in zip(b["key"], b["before"], b["bytes"], b["n"], b["rows"], b["places"]):
                c = one.setdefault((k, before, data), [0, [], []])
                c[0] += n
                c[1].extend(rows)
                c[2].extend(places)
            keys, held = list(one), list(one.values())
            z = np.zeros(len(keys), np.int64)
            runs = solve([k[0] for k in keys], [k[1] for k in keys], z, z + reach, [k[2] for k in keys], [min(h[0], 2) for h in held])
            out = [(r, x["s"] + p, x["e"] + p) for i, xs in runs.items() for x in xs for r, p in zip(held[i][1], held[i][2])]
            yield pd.DataFrame(out, columns=["row", "s", "e"]).astype("int64")

    return contexts.repartition(_parts(contexts.sparkSession), "key").sortWithinPartitions("key").mapInPandas(run, RUNS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str, int]:
    """(rows, rows_at, runs_at, partitions): all rows, where they lie by partition, and where the runs [s, e) to remove do."""
    spark = docs.sparkSession
    ship(spark)
    rows_at, places_at, runs_at = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    rows = _anchored(docs, id_col, text_col, rows_at)
    pids = (rows.agg(F.max("pid")).first()[0] or 0) + 1
    pairs = rows.select("row", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("row", F.col("x.places").alias("place"), F.col("x.hashes").alias("key"))
    again = rows.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # Written, so that both sides of the join are plain exchanges and a very frequent anchor's rows can be split.
    again = written(again.select("key", (F.col("c") > HOT).alias("hot")))
    # One row stands for equal texts; their number counts.
    prints = rows.where(F.col("n_bytes") >= SPAN).groupBy("print").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    prints = prints.select("row", F.least("copies", F.lit(2)).cast("int").alias("n"))
    places = pairs.join(again.hint("merge"), "key").join(prints.hint("merge"), "row")
    _by_pid(places.select("row", "place", "key", "hot", "n").repartition(_parts(spark), _pid()), places_at)
    contexts = written(_contexts(spark, rows_at, places_at, pids))
    runs = _runs_of(contexts.where("NOT hot").drop("hot"))
    hot = contexts.where("hot").select("key", _name().alias("cid"), "before", "bytes", "n", "rows", "places")
    if not hot.isEmpty():
        one = hot.groupBy("key", "cid", "before", "bytes").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
        one = one.select("key", "cid", "before", F.lit(0).alias("lo"), F.lit(SPAN - KMER).alias("hi"), "bytes", "n")
        solved = _resolve(written(one))
        o = hot.select("key", "cid", F.explode(F.arrays_zip("rows", "places")).alias("o")).join(solved.hint("merge"), ["key", "cid"])
        o = o.select(F.col("o.rows").alias("row"), F.col("o.places").alias("p"), F.explode("runs").alias("r"))
        runs = runs.unionByName(o.select("row", (F.col("r.s") + F.col("p")).alias("s"), (F.col("r.e") + F.col("p")).alias("e")))
    _by_pid(runs.repartition(_parts(spark), _pid()), runs_at)
    return rows, rows_at, runs_at, pids


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """id, print, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_bytes adds what is left of changed texts."""
    rows, rows_at, runs_at, pids = repeated_spans(docs, id_col, text_col)

    def cut(batches):
        for b in batches:
            for pid in b["id"]:
                runs = _table(runs_at, pid, ["row", "s", "e"]).sort_values("row", kind="stable")
                row, s, e = (runs[c].to_numpy(np.int64) for c in ("row", "s", "e"))
                for texts in _part(rows_at, pid, ["row", "print", "text"]) if len(row) else ():
                    out = []
                    for r, p, text in zip(texts.column("row").to_pylist(), texts.column("print").to_pylist(), texts.column("text")):
                        a, z = np.searchsorted(row, [r, r + 1])
                        if a == z:
                            continue
                        data, spans = text.as_buffer().to_pybytes(), _merged(list(zip(s[a:z].tolist(), e[a:z].tolist())))
                        at, kept = 0, []
                        for x, y in spans:
                            kept.append(data[at:x])
                            at = y
                        left = b"".join([*kept, data[at:]])
                        out.append((p, len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
                    yield pd.DataFrame(out, columns=["print", "n_removed", "n_spans", "kept", "left"]).astype({"n_removed": "int64", "n_spans": "int64", "left": object})

    done = docs.sparkSession.range(0, pids, 1, pids).mapInPandas(cut, "print string, n_removed long, n_spans long, kept string, left binary")
    d = rows.select("id", "print", "n_bytes").join(done.hint("merge"), "print", "left")
    zero = F.lit(0).cast("long")
    return d.select(F.col("id").alias(id_col), "print", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                    F.coalesce("kept", "print").alias("kept_sha256"), *(["left"] if with_bytes else []))


def op9(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
