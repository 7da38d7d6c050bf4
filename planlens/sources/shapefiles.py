"""Zipped shapefiles as rows: one for each record, with its attributes and its rings."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from planlens.shipping import ship

SCHEMA = "layer string, rec int, attributes map<string,string>, x double, y double, rings array<array<struct<x:double,y:double>>>"

# The format's kinds of shape, plain, with z and with m.
POINT, POLYGON = (1, 11, 21), (5, 15, 25)


def shapes(data: bytes) -> Iterator[tuple[float | None, float | None, list | None]]:
    """x, y of points and the rings of polygons, without their closing corner, in the order of records; nulls for other kinds."""
    at = 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        at += 8
        (kind,) = struct.unpack_from("<i", data, at)
        if kind in POINT:
            yield (*struct.unpack_from("<dd", data, at + 4), None)
        elif kind in POLYGON:
            parts, points = struct.unpack_from("<ii", data, at + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 44), points]
            xy = np.frombuffer(data, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            rings = []
            for a, b in zip(starts, starts[1:]):
                ring = xy[a:b]
                if len(ring) > 1 and (ring[0] == ring[-1]).all():
                    ring = ring[:-1]
                rings.append([{"x": x, "y": y} for x, y in ring.tolist()])
            yield None, None, rings
        else:
            yield None, None, None
        at += 2 * words


def attributes(data: bytes, encoding: str) -> Iterator[dict[str, str | None]]:
    """The attribute table's rows as text; empty fields are null."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    for i in range(count):
        at = head + i * size + 1
        row = {}
        for name, width in fields:
            row[name] = data[at : at + width].decode(encoding, "replace").strip(" \0") or None
            at += width
        yield row


def read_zip(content: bytes) -> Iterator[tuple]:
    """layer, record, attributes, x, y, rings of all layers of a zip file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {n.lower(): n for n in z.namelist()}
        for low in sorted(names):
            stem = low.removesuffix(".shp")
            if stem == low:
                continue
            part = lambda end: z.read(names[stem + end]) if stem + end in names else None  # noqa: B023, E731
            table, declared = part(".dbf"), part(".cpg")
            rows = attributes(table, (declared or b"latin-1").decode("ascii").strip()) if table else iter(())
            layer = names[low].rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for rec, (x, y, rings) in enumerate(shapes(z.read(names[low]))):
                yield layer, rec, next(rows, {}), x, y, rings


def read(spark: SparkSession, path: str) -> DataFrame:
    """layer, rec, attributes, x, y (points), rings (polygons) of the zip files at a path or pattern; a file is a task's row, up to 2 GB."""
    ship(spark)

    def run(batches):
        for b in batches:
            for content in b["content"]:
                held = []
                for row in read_zip(content):
                    held.append(row)
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=["layer", "rec", "attributes", "x", "y", "rings"])
                        held = []
                yield pd.DataFrame(held, columns=["layer", "rec", "attributes", "x", "y", "rings"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
