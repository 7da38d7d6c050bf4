"""Best-fit packing by hierarchical residual packing.

Each partition packs its own documents best-fit, longest first, and gives out the bins that are nearly full. Underfull
bins are the items of the next round, which has fewer partitions; rounds go on while they lessen the number of
underfull bins. A task never holds more than MOST items, whatever the input: where more underfull bins remain, the round keeps as many
partitions as that bound asks for.

Defined results: null and empty texts are the end id alone; repeated rows are packed one by one; null ids are carried;
documents longer than a sequence are cut into pieces, all but the last of them full; an empty table gives no rows;
extra columns are ignored; which of several equally good bins an item takes is left open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import ship, shipped, text_of, written
from planlens.llm.encoding import encoder, words

ITEM = np.dtype([("id", "<i8"), ("none", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "seq long, fill int, full boolean, members binary"
ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Tokens a bin may lack and still count as full; items a task packs at once; how many partitions' rests meet in one.
SLACK, MOST, FAN_IN = 2, 100_000, 16


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit, longest first: bins as lists of items. Free space is looked up in the bits of one integer."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    some = 0  # bit f is set if a bin has f free
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
            bins[k].append(int(i))
        else:
            free, k = size, len(bins)
            bins.append([int(i)])
        if free > n:
            by_free.setdefault(free - n, []).append(k)
            some |= 1 << (free - n)
    return bins


def _packed(fills: list[int], members: list[bytes], size: int, slack: int, number) -> pd.DataFrame:
    lengths = np.array(fills, np.int64)
    rows = []
    for b in best_fit(lengths, size):
        fill = int(lengths[b].sum())
        rows.append((next(number), fill, size - fill <= slack, b"".join(members[i] for i in b)))
    return pd.DataFrame(rows, columns=["seq", "fill", "full", "members"])


def _numbers(level: int):
    n = (level << 58) | (TaskContext.get().partitionId() << 34)
    while True:
        yield n
        n += 1


def pieces_of(ids: np.ndarray, doc_id: int, none: bool, size: int) -> np.ndarray:
    ids = np.ascontiguousarray(ids, "<u4")
    starts = range(0, len(ids), size)
    return np.array([(doc_id, none, k, a, len(x := ids[a : a + size]), zlib.crc32(x)) for k, a in enumerate(starts)], ITEM)


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, cut=words, slack: int = SLACK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its place in its document, and in a sequence of at most size tokens."""

    def local(batches):
        encode, number, fills, members = encoder(shipped(path), cut), _numbers(0), [], []
        for b in batches:
            for a in range(0, len(b), 4096):
                some = b.iloc[a : a + 4096]
                for t, i, none in zip(encode(list(some["text"])), some["id"].fillna(0), some["none"]):
                    for p in pieces_of(np.append(t, end_id), int(i), none, size):
                        fills.append(int(p["length"]))
                        members.append(p.tobytes())
                if len(fills) >= MOST:
                    yield _packed(fills, members, size, slack, number)
                    fills, members = [], []
        if fills:
            yield _packed(fills, members, size, slack, number)

    def again(level):
        def merge(batches):
            number, fills, members = _numbers(level), [], []
            for b in batches:
                fills += [int(x) for x in b["fill"]]
                members += list(b["members"])
                if len(fills) >= 2 * MOST:
                    yield _packed(fills, members, size, slack, number)
                    fills, members = [], []
            if fills:
                yield _packed(fills, members, size, slack, number)

        return merge

    ship(docs.sparkSession, path)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).isNull().alias("none"), text_of(text_col).alias("text"))
    bins = written(d.mapInPandas(local, BINS))
    full, rest = [bins.where("full")], bins.where(~F.col("full"))
    n, parts, level = rest.count(), 1 << 30, 0
    while n > 1 and parts > 1:
        level += 1
        parts = max(1, -(-n // MOST)) if level > 1 or n <= MOST else max(1, -(-n // max(1, MOST // FAN_IN)))
        bins = written(rest.select("fill", "members").repartition(parts).mapInPandas(again(level), BINS))
        full.append(bins.where("full"))
        rest = bins.where(~F.col("full"))
        before, n = n, rest.count()
        if level > 1 and n > 0.98 * before:
            break
    every = rest
    for x in full:
        every = every.unionByName(x)

    def unpack(batches):
        for b in batches:
            rows = [np.frombuffer(x, ITEM) for x in b["members"]]
            n = [len(x) for x in rows]
            x = np.concatenate(rows) if rows else np.zeros(0, ITEM)
            length = x["length"].astype(np.int64)
            ends = np.cumsum(length)
            first = np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) if rows else np.zeros(0, np.int64)
            before = ends - length
            yield pd.DataFrame({
                "doc_id": pd.Series(x["id"].astype(np.int64), dtype="Int64").mask(x["none"] == 1), "piece": x["piece"].astype(np.int32),
                "start": x["start"].astype(np.int64), "length": length, "ids_crc32": x["crc"].astype(np.int64),
                "sequence_id": np.repeat(b["seq"].to_numpy(), n), "offset": before - before[first],
            })

    return every.select("seq", "members").mapInPandas(unpack, ROWS)


def op5(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path)
