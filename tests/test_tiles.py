"""Tiles of tables of grids: windows of turned grids against brute force, selection order, resolutions, sessions."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import tiles

WORLD = math.pi * 6378137.0
SCHEMA = "grid string, affine array<double>, rows long, cols long, block_rows int, block_cols int, decimations array<int>, crs string"
NORTH = ("north", [100.0, 0.0, 200000.0, 0.0, -100.0, 6000000.0], 6000, 8000, 512, 512, [1, 2, 4, 8], "EPSG:3857")
SHEARED = ("sheared", [90.0, 40.0, -300000.0, -25.0, -80.0, 5000000.0], 3000, 2500, 256, 512, [1, 3, 9], "EPSG:3857")
DEGREES = ("degrees", [0.01, 0.0, 5.0, 0.0, -0.01, 45.0], 900, 1200, 128, 128, [1, 2], "EPSG:4326")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def reach(g):
    """Bounds in Mercator metres over the grid's four corners."""
    a, b, c, d, e, f = g[1]
    at = [(a * i + b * j + c, d * i + e * j + f) for i in (0, g[3]) for j in (0, g[2])]
    if g[7] == "EPSG:4326":
        at = [(math.radians(u) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) * 6378137.0) for u, v in at]
    return min(u for u, _ in at), min(v for _, v in at), max(u for u, _ in at), max(v for _, v in at)


def window(g, z, x, y):
    """(c0, c1, r0, r1, inside) by solving for each corner, or nothing; nothing either where the tile doesn't meet the grid's bounds."""
    side = 2 * WORLD / 2**z
    u0, v0, u1, v1 = reach(g)
    if not (math.floor((u0 + WORLD) / side) <= x <= math.floor((u1 + WORLD) / side) and math.floor((WORLD - v1) / side) <= y <= math.floor((WORLD - v0) / side)):
        return None
    us, vs = [x * side - WORLD, (x + 1) * side - WORLD], [WORLD - (y + 1) * side, WORLD - y * side]
    if g[7] == "EPSG:4326":
        us = [math.degrees(u / 6378137.0) for u in us]
        vs = [math.degrees(2 * math.atan(math.exp(v / 6378137.0)) - math.pi / 2) for v in vs]
    import numpy as np

    a, b, c, d, e, f = g[1]
    corners = [np.linalg.solve([[a, b], [d, e]], [u - c, v - f]) for u in us for v in vs]
    cs, rs = [k[0] for k in corners], [k[1] for k in corners]
    c0, c1, r0, r1 = max(0.0, min(cs)), min(g[3], max(cs)), max(0.0, min(rs)), min(g[2], max(rs))
    return None if c1 <= c0 or r1 <= r0 else (c0, c1, r0, r1, min(cs) >= -0.5 and max(cs) <= g[3] + 0.5 and min(rs) >= -0.5 and max(rs) <= g[2] + 0.5)


def chunks(g, w, k):
    span = lambda lo, hi, n: max(1, math.floor((hi / k - 1e-9) / n) - math.floor(lo / k / n) + 1)
    return span(w[0], w[1], g[5]) * span(w[2], w[3], g[4])


@pytest.mark.parametrize("g", [NORTH, SHEARED, DEGREES])
def test_windows(spark, g):
    for z in (5, 8):
        got = {(r.x, r.y): (r.chunks, r.interior) for r in tiles.zoom_tiles(frame(spark, g), F.array(F.lit(z))).collect()}
        native = tiles.located(frame(spark, g)).first().native_metres
        k = max([d for d in g[6] if native * d <= 2 * WORLD / 256 / 2**z], default=min(g[6]))
        want = {(x, y): w for x in range(2**z) for y in range(2**z) if (w := window(g, z, x, y))}
        assert got.keys() == want.keys()
        assert all(got[at] == (chunks(g, w, k), w[4]) for at, w in want.items())


def test_zooms(spark):
    res = lambda z: 2 * WORLD / 256 / 2**z
    for wanted, z in ((res(7), 7), (res(7) * 1.000000001, 7), (res(7) * 1.1, 7), (res(7) * 1.5, 6), (res(7) * 0.9, 7), (res(0) * 50, 0), (1e-9, 24)):
        assert spark.range(1).select(tiles.zoom_for(F.lit(wanted)).alias("z")).first().z == z


def test_best_tiles_in_order(spark):
    rows = [(3, 0, 0, 1, False), (3, 1, 0, 1, True), (3, 2, 0, 1, True), (3, 1, 5, 1, True), (2, 0, 0, 4, False), (2, 1, 0, 1, True), (1, 0, 0, 4, True), (1, 0, 0, 2, True)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1, 7, 7, 4, False)], "grid string, z int, x long, y long, chunks long, interior boolean")
    got = {(r.grid, r.target): (r.chunks, r.z, r.x, r.y, r.interior) for r in tiles.best_tiles(df, [1, 4]).collect()}
    assert got == {("a", 1): (1, 3, 1, 0, True), ("a", 4): (4, 2, 0, 0, False), ("b", 4): (4, 1, 7, 7, False)}
    # Nine or more: the smallest larger number of what has been met by then.
    more = df.unionByName(spark.createDataFrame([("a", 2, 0, 0, 20, True), ("a", 1, 0, 0, 12, True), ("a", 0, 0, 0, 9, True)], df.schema))
    served = lambda *t: {r.target: (r.chunks, r.approximate) for r in tiles.best_tiles(more, list(t)).where("grid = 'a'").collect()}
    assert served(1, 9) == {1: (1, False), 9: (20, True)}
    assert served(2, 9) == {2: (2, False), 9: (12, True)}
    assert served(1, 3) == {1: (1, False)}


def test_selection_by_scan(spark):
    """All three grids at once give what a scan of each, zoom by zoom, gives."""
    all_of = (NORTH, SHEARED, DEGREES)
    got = {(r.grid, r.target): (r.chunks, r.z, r.x, r.y) for r in tiles.chunk_tiles(frame(spark, *all_of)).collect()}
    zooms = {r.grid: (r.native_zoom, r.native_metres) for r in tiles.located(frame(spark, *all_of)).collect()}
    want = {}
    for g in all_of:
        best = {}
        match = lambda t, best=best: t if t in best else min((c for c in best if c >= t), default=None) if t >= 9 else None
        native, metres = zooms[g[0]]
        for z in range(native, max(0, native - len(g[6]) - 4) - 1, -1):
            k = max([d for d in g[6] if metres * d <= 2 * WORLD / 256 / 2**z], default=min(g[6]))
            for x in range(2**z):
                for y in range(2**z) if z < 9 else ():
                    if w := window(g, z, x, y):
                        n = chunks(g, w, k)
                        if n not in best or w[4] and not best[n][0]:
                            best[n] = (w[4], z, x, y)
            if all(match(t) for t in (1, 2, 4, 9)):
                break
        if native < 9:
            want |= {(g[0], t): (match(t), *best[match(t)][1:]) for t in (1, 2, 4, 9) if match(t)}
    assert want and {k: got[k] for k in want} == want


def test_resolutions_and_sessions(spark):
    got = {r.wanted: r for r in tiles.resolution_tiles(frame(spark, NORTH), [250.0, 900.0, 1e9]).collect()}
    assert got[250.0].decimation == 2 and got[900.0].decimation == 8 and got[250.0].interior and got[1e9].z == 0
    assert {r.wanted for r in tiles.resolution_tiles(frame(spark, SHEARED)).collect()} == {90.0, 270.0, 810.0}
    steps = sorted((r.step, r.action, r.z, r.x, r.y, r.chunks) for r in tiles.sessions(frame(spark, NORTH)).collect())
    assert [s[1] for s in steps] == ["start", "zoom_in", "zoom_in", "zoom_in", "pan_e", "pan_s", "pan_w", "pan_n", "zoom_out", "zoom_out"]
    z, x, y = steps[3][2:5]
    assert [s[2:5] for s in steps[4:]] == [(z, x + 1, y), (z, x + 1, y + 1), (z, x, y + 1), (z, x, y), (z - 1, x // 2, y // 2), (z - 2, x // 4, y // 4)]
    centre = (200000.0 + 400000.0, 6000000.0 - 300000.0)
    side = 2 * WORLD / 2**z
    assert (x, y) == (int((centre[0] + WORLD) // side), int((WORLD - centre[1]) // side)) and all(s[5] >= 1 for s in steps)
    tiny = ("tiny", [1.0, 0.0, 5.0, 0.0, -1.0, 5.0], 3, 3, 1, 1, [1], "EPSG:3857")
    assert 0 in {r.chunks for r in tiles.sessions(frame(spark, tiny)).collect()}
    named = tiles.scenarios(frame(spark, NORTH, DEGREES))
    assert {r.label for r in named.where("grid = 'north'").collect()} >= {"1chunk", "res_100m", "res_800m", "pan_zoom_00_start", "pan_zoom_07_pan_n"} and "res_0.02m" in {r.label for r in named.collect()}
    with pytest.raises(Exception, match="no closed form"):
        tiles.chunk_tiles(frame(spark, (*NORTH[:7], "EPSG:32631"))).collect()
    assert tiles.scenarios(frame(spark).limit(0)).count() == 0
