"""Every registered query of the library's own operators, against DuckDB where there is SQL."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridloom import adapters
from gridloom.functions import scalar
from gridloom.operators import raster as rasters
from gridloom.operators import stencil
from gridloom.plans import ORACLES, QUERIES, matching
from test_kernels import zigzag

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, int | float) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def images(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.x, r.y] = r.v
    return out


def box(w):
    """Offsets of a box of side w, whose even sides reach one further to the left."""
    return range(-(w // 2), w - w // 2)


def suppressed(values, w=8):
    """Positive pixels that are their box's maximum, and of equal ones in a box the last by column."""
    size = {(x, y): v for (x, y), v in values.items() if v > 0}
    top = {p for p, v in size.items() if all(values.get((p[0] + a, p[1] + b), 0) <= v for a in box(w) for b in box(w))}
    number = {p: i for i, p in enumerate(sorted(top), 1)}
    return {p for p in top if all(number.get((p[0] + a, p[1] + b), 0) <= number[p] for a in box(w) for b in box(w))}


def ranked(values, n):
    return {(x, y, k) for k, (x, y) in enumerate(sorted(suppressed(values), key=lambda p: (-values[p], p)), 1) if k <= n}


def harris(values):
    at = lambda x, y: values.get((x, y), 0.0)
    gx = {(x, y): sum(w * (at(x + 1, y + d) - at(x - 1, y + d)) for d, w in ((-1, 1), (0, 2), (1, 1))) for x, y in values}
    gy = {(x, y): sum(w * (at(x + d, y + 1) - at(x + d, y - 1)) for d, w in ((-1, 1), (0, 2), (1, 1))) for x, y in values}
    out = {}
    for x, y in values:
        near = [p for a in box(6) for b in box(6) if (p := (x + a, y + b)) in values]
        xx, yy, xy = sum(gx[p] ** 2 for p in near), sum(gy[p] ** 2 for p in near), sum(gx[p] * gy[p] for p in near)
        out[x, y] = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    return out


def segments(values, limit=6.0):
    out = {}
    for (x, y), v in values.items():
        ring = [values.get((x + a, y + b)) for a, b in stencil.CIRCLE]
        if None not in ring:
            d = [r - v for r in ring] * 2
            out[x, y] = max(max(min(d[s : s + 9]), -max(d[s : s + 9])) for s in range(16))
    return {p: v for p, v in out.items() if v > limit}


def islands(values, percent):
    """A pixel's largest level at which it is foreground once small components of both kinds are flipped."""
    out = {}
    for level in range(255):
        fg = {p: v >= level for p, v in values.items()}
        left = set(fg)
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                near = {q for a in (-1, 0, 1) for b in (-1, 0, 1) if (q := (x + a, y + b)) in left and fg[q] == fg[x, y]}
                left -= near
                todo += near
            flip = len(part) < percent / 100 * len(fg)
            for p in part:
                if fg[p] != flip:
                    out[p] = max(out.get(p, 0), level)
    return {p: out.get(p, 0) for p in values}


def basins(v):
    """Persistence pairs from the definition: at each merging sample the basin with the higher minimum (the right one on ties) ends."""
    pairs, there = [], set()
    for i in sorted(range(len(v)), key=lambda i: (v[i], i)):
        sides = []
        for step in (-1, 1):
            part, k = [], i + step
            while k in there:
                part.append(k)
                k += step
            if part:
                sides.append(min(part, key=lambda k: (v[k], k)))
        if len(sides) == 2:
            ends = sides[0] if v[sides[1]] < v[sides[0]] else sides[1]
            pairs.append((ends, i, v[i] - v[ends]))
        there.add(i)
    return pairs


def series(spark):
    out = {}
    for r in sorted(adapters.signal(spark, SF).collect()):
        out.setdefault(r.series_id, ([], []))[0].append(r.idx)
        out[r.series_id][1].append(r.v)
    return out


def check_pairs(spark, got):
    assert {tuple(r) for r in got} == {(s, i[a], i[b], p) for s, (i, v) in series(spark).items() for a, b, p in basins(v) if p >= 2}


def check_pair_counts(spark, got):
    want = {s: [p for _, _, p in basins(v) if p >= 5] for s, (_, v) in series(spark).items()}
    assert {r.series_id: (r.n, r.least) for r in got} == {s: (len(p), min(p)) for s, p in want.items() if p}


def check_extrema(spark, got):
    want = {(s, i[k], kind) for s, (i, v) in series(spark).items() for a, b, p in basins(v) if p >= 2 for k, kind in ((a, "min"), (b, "max"))}
    assert {(r.series_id, r.idx, r.kind) for r in got} == want and len(got) == len(want)


def check_peaks(spark, got):
    assert {tuple(r) for r in got} == {(s, i[k]) for s, (i, v) in series(spark).items() for k in zigzag(v, 4.0, False)}


def check_crc32(spark, got):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {(r.doc_id, r.crc) for r in got} == {(r.doc_id, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs}


def check_buffer_crc(spark, got):
    table = [0] * 256
    for n in range(256):
        for k, word in enumerate(scalar.CRC_GENERATOR):
            table[n] ^= word if n >> k & 1 else 0
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 0").collect():
        c = 0
        for b in r.text.encode():
            c = c >> 8 ^ table[c & 255 ^ b]
        want[r.doc_id] = c
    assert {r.doc_id: r.crc for r in got} == want


def check_ppm(spark, got):
    raster = adapters.part_raster(spark, SF)
    want = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in rasters.colour(rasters.normalise(raster)).collect()}
    assert len(got) == len(want)
    assert all(abs(c - 255 * w) <= 1 for r in got for c, w in zip((r.r, r.g, r.b), want[r.image_id, r.x, r.y], strict=True))


def check_thinned(spark, got):
    want = {}
    for image, values in images(adapters.event_raster(spark, SF)).items():
        on = {p for p, v in values.items() if v >= 4}
        for x, y in sorted(on, key=lambda p: (p[1], p[0])):
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (x + a, y + b) in on}
            parts, left = 0, set(near)
            while left:
                parts, todo = parts + 1, [left.pop()]
                while todo:
                    u, v = todo.pop()
                    more = {q for q in left if abs(q[0] - u) <= 1 and abs(q[1] - v) <= 1}
                    left -= more
                    todo += more
            if len(near) >= 2 and parts < 2:
                on.discard((x, y))
        want |= {(image, *p): 255.0 if p in on else 0.0 for p in values}
    assert {(r.image_id, r.x, r.y): r.v for r in got} == want


def check_corners(adapter, response, n):
    def run(spark, got):
        want = {(i, *r) for i, values in images(adapter(spark, SF)).items() for r in ranked(response(values), n)}
        assert {(r.image_id, r.x, r.y, r["rank"]) for r in got} == want and len(got) > 3

    return run


def check_islands(spark, got):
    want = {(i, *p): float(v) for i, values in images(adapters.part_raster(spark, SF)).items() for p, v in islands(values, 0.5).items()}
    assert {(r.image_id, r.x, r.y): r.v for r in got} == want


def check_marching(spark, got):
    """Distances are there for every pixel that has one (test_kernels.py compares them with exact ones)."""
    assert got and all(r.dt is None or r.dt >= 0 for r in got)


CHECKS = {
    "top01_persistence": check_pairs,
    "top02_pairs_by_threshold": check_pair_counts,
    "top03_extrema": check_extrema,
    "win01_peaks": check_peaks,
    "scl14_buffer_crc": check_buffer_crc,
    "scl15_crc32": check_crc32,
    "src09_ppm": check_ppm,
    "nbr07_thin_double": check_thinned,
    "udf04_harris_corners": check_corners(adapters.part_raster, harris, 20),
    "udf01_detect_fast": check_corners(adapters.embed_raster, segments, 50),
    "grf02_remove_islands": check_islands,
    "dst10_marching": check_marching,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canon(got, df.columns) == canon(found.fetchall(), columns)
    elif name in CHECKS:
        CHECKS[name](spark, got)
    else:  # kernels that test_kernels.py compares with brute force: rows of places and numbers
        keys = [c for c in df.columns if c in ("image_id", "series_id", "level", "x", "y", "idx", "rank")]
        assert got and len(keys) >= 2 and not any(r[c] is None for r in got for c in keys)


def test_full_sizes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 700, (2, 260, 2))
    rows = [("s", str(m), m * 1000 + i, float(x), float(y), 1000.0 - i, rng.normal(size=64).tolist()) for m in (0, 1) for i, (x, y) in enumerate(p[m])]
    table = spark.createDataFrame(rows, "scene string, image_id string, kp_id long, x double, y double, response double, descriptor array<double>")
    monkeypatch.setattr(matching.A, "keypoints", lambda s, d: table)
    run = lambda name: QUERIES[name](spark, "").collect()
    close = ((p[0][:, None] - p[1][None]) ** 2).sum(-1) <= 3600
    match = {i: int(np.flatnonzero(row)[0]) for i, row in enumerate(close) if row.any()}
    assert {(r.i, r.j) for r in run("jn03_repeated_pairs_full")} == {(i, j) for i, j in match.items() if i < 200 and j <= 200}
    assert abs(run("agg10_average_precision_full")[0].ap - np.mean([(h + 1) / (i + 1) for h, i in enumerate(sorted(i for i, j in match.items() if j <= i)[:100])])) < 1e-9
    d = np.sqrt(((p[0][:200, None] - p[0][None, :200]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(run("jn06_pair_distances_full")) == 200 * 199
    assert abs(run("agg11_coverage_full")[0].coverage - 200 / ((1 / d).sum() / 199)) < 1e-6
    curve = {r.k: r.repeated for r in run("jn04_prefix_matches_full")}
    near = ((p[0][:, None] - p[1][None]) ** 2).sum(-1) <= 90000
    assert len(curve) == 260 and all(abs(curve[k] - near[:k, :k].any(axis=1).sum() / k) < 1e-9 for k in curve)
