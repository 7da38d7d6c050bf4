"""Readers, sinks and plan archives."""

import hashlib
import json

import numpy as np

from planlens.functions import rational as R
from planlens.operators import brackets as B
from planlens.sources import instances, runs


def doc(state, lo, hi, regime="feasible", tag="a"):
    rec = {"state": state, "party": "D", "cap": 1, "eps": "1/100", "contests": ["PRE"], "q": 1, "m": "heuristic", "status": "heuristic", "seconds": 1.0, "iters": 0, "cells": 0}
    per = {"regime": regime}
    if regime == "feasible":
        per["1"] = {"lo": 1, "hi": 2, "unknown": [], "best_margin": lo, "lo_m": lo, "hi_m": hi}
    return {"job": f"{state}_{tag}", "seconds": 2.0, "spectrum": per, "records": [rec]}


def test_run_documents(spark, tmp_path):
    for tag, docs in {"a": [doc("X", "1/10", "1/5"), doc("Y", None, "0")], "b": [doc("X", "3/20", None), doc("Z", None, None, "infeasible")]}.items():
        (tmp_path / tag).mkdir()
        for i, d in enumerate(docs):
            (tmp_path / tag / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "a" / "audit_x.json").write_text(json.dumps({"agree": 1, "disagree": 0, "unknown": 2}))
    (tmp_path / "a" / "other.json").write_text(json.dumps({"job": "none"}))
    r = runs.read_runs(spark, {t: str(tmp_path / t / "*.json") for t in "ab"})
    assert r.count() == 4
    f = runs.facts(r)
    m = {x.state: x for x in B.merge(f).collect()}
    assert (m["X"].lo.n, m["X"].lo.d, m["X"].hi.n, m["X"].hi.d, m["X"].seconds, m["X"].unknown) == (3, 20, 1, 5, 4.0, True)
    assert m["Y"].lo is None and not m["Y"].unknown and "Z" not in m
    assert B.violations(f).isEmpty()
    rec = runs.records(r)
    assert rec.where(R.parse(rec["m"]).isNull()).count() == 4
    runs.write_runs(r.drop("spectrum"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    a = runs.read_json(spark, str(tmp_path / "a" / "audit*.json"), runs.AUDIT).first()
    assert (a.agree, a.unknown) == (1, 2)


def test_instances_and_plans(spark, tmp_path):
    i = instances.grid(spark, 3, 3, 1)
    instances.save(i, "one", str(tmp_path))
    instances.save(instances.grid(spark, 2, 2, 1), "two", str(tmp_path))
    back = instances.load(spark, "one", str(tmp_path))
    assert sorted(back.atom.collect()) == sorted(i.atom.collect()) and back.edge.count() == i.edge.count()
    d = [0, 1, 2, 300, 5, 0, 1, 2, 3]
    p = spark.createDataFrame([("p", 301, a, j) for a, j in enumerate(d)], "plan string, k int, atom_id int, district int")
    want = hashlib.sha256(np.array(d, "<i2").tobytes()).hexdigest()[:16]
    assert instances.plan_hashes(p).first().plan_hash == want == instances.plan_hash(d)
    assert instances.from_archive(spark.createDataFrame([(want, 1)], "plan_hash string, q int"), p).count() == 9


def test_zipped_shapefile_with_a_hole(spark, tmp_path):
    import struct
    import zipfile

    from planlens.operators import ingest as I
    from planlens.sources import shapefiles

    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]

    def polygon(rings):
        pts = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        return struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)

    bodies = [polygon([square(0.0, 10.0), square(4.0, 6.0)]), struct.pack("<i", 0), polygon([square(20.0, 30.0)])]
    shp = bytes(100) + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    field = lambda n, t, w: n.encode().ljust(11, b"\0") + t + bytes(4) + bytes([w, 0]) + bytes(14)
    names, codes = ["Añasco", "", "Two"], ["001", "002", "003"]
    head = 32 + 2 * 32 + 1
    dbf = struct.pack("<4BIHH", 3, 120, 1, 1, 3, head, 1 + 10 + 3) + bytes(20) + field("NAME", b"C", 10) + field("CODE", b"C", 3) + b"\r"
    for n, c in zip(names, codes):
        raw = n.encode()
        dbf += b" " + raw + b" " * (10 - len(raw)) + c.encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for end, data in ((".shp", shp), (".dbf", dbf), (".cpg", b"UTF-8")):
            z.writestr("folder/Places" + end, data)
    rows = shapefiles.read(spark, str(tmp_path / "*.zip")).orderBy("rec").collect()
    assert [(r.layer, r.rec, r.attributes) for r in rows] == [("Places", i, {"NAME": n or None, "CODE": c}) for i, (n, c) in enumerate(zip(names, codes))]
    assert [len(r.rings) if r.rings is not None else None for r in rows] == [2, None, 1] and len(rows[0].rings[0]) == 4
    polys = shapefiles.read(spark, str(tmp_path / "*.zip")).where("rings is not null").withColumnRenamed("rec", "poly_id")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 25.0, 21.0), (4, 15.0, 15.0), (5, 19.0, 25.0)], "id int, x double, y double")
    assert {r.id: r.poly_id for r in I.within(points, polys, 3.0).collect()} == {1: 0, 2: None, 3: 2, 4: None, 5: None}
    assert {r.id: r.poly_id for r in I.in_districts(points, polys, 3.0).collect()} == {1: 0, 2: 0, 3: 2, 4: 0, 5: 2}
