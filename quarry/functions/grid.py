"""Column expressions of grid algebra: geotransforms, pyramids, chunks, tiles, space-filling curves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the width of the web-Mercator world in metres, and the side of a tile in pixels.
WORLD, TILE = math.pi * 6378137.0, 256


def floor_log2(n: Column) -> Column:
    """Exact for whole numbers from 1."""
    return F.length(F.bin(n)) - 1


def parse_geotransform(text: Column) -> Column:
    """Six numbers, or null."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 6) & ~F.exists(parts, lambda x: x.isNull()), parts)


def pixel_size(gt: Column) -> Column:
    return F.abs(gt[1])


def decimate(gt: Column, by: Column) -> Column:
    """Coarser grid with the same origin."""
    return F.array(gt[0], gt[1] * by, gt[2] * by, gt[3], gt[4] * by, gt[5] * by)


def affine_order(gt: Column) -> Column:
    """(a, b, c, d, e, f) of an origin-first transform."""
    return F.array(gt[1], gt[2], gt[0], gt[4], gt[5], gt[3])


def bounds(gt: Column, rows: Column, cols: Column) -> Column:
    """(xmin, ymin, xmax, ymax) over all four corners, so rotated grids are right."""
    corners = [(F.lit(0), F.lit(0)), (cols, F.lit(0)), (F.lit(0), rows), (cols, rows)]
    xs, ys = (F.array(*[gt[k] + gt[k + 1] * c + gt[k + 2] * r for c, r in corners]) for k in (0, 3))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def auto_depth(rows: Column, cols: Column, least: int = 256) -> Column:
    """How often the shorter side can be halved and stay at ``least`` or above."""
    ratio = F.expr("1") * F.floor(F.least(rows, cols) / F.lit(least)).cast("long")
    return F.when(ratio >= 1, floor_log2(ratio)).otherwise(0).cast("int")


def fit_chunk(chunk: Column, n: Column) -> Column:
    return F.least(F.greatest(chunk, F.lit(1)), n)


def fit_shard(shard: Column, chunk: Column, n: Column) -> Column:
    """Whole multiples of the chunk, one at least."""
    return F.greatest(chunk, F.floor(F.least(shard, n) / chunk) * chunk)


def auto_shard(n: Column, chunk: Column) -> Column:
    return F.ceil(n / chunk) * chunk


def blocks_spanned(low: Column, high: Column, block: Column) -> Column:
    """Blocks that a half-open pixel range touches; one at least."""
    return F.greatest(F.lit(1), (F.floor((high - F.lit(1e-9)) / block) - F.floor(low / block) + 1).cast("long"))


def index_bytes(features: Column, node_size: Column) -> Column:
    """Bytes of a packed R-tree: 40 for each node of each level, leaves first, up to one root."""
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.struct(features.cast("long").alias("n"), features.cast("long").alias("nodes")),
        lambda a, _: F.when(a["n"] <= 1, a).otherwise(F.struct(F.ceil(a["n"] / node_size).alias("n"), (a["nodes"] + F.ceil(a["n"] / node_size)).alias("nodes"))),
    )
    return F.when(features > 0, (levels["nodes"] + F.when(features == 1, 1).otherwise(0)) * 40).otherwise(F.lit(0)).cast("long")


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Distance along the Hilbert curve of a cell of a 2**bits square: one projection, no Python."""
    d = F.lit(0).cast("long")
    x, y = x.cast("long"), y.cast("long")
    state = F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("long"), (a["y"].bitwiseAND(s) > 0).cast("long")
        add = s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        # The quadrant is turned so that the curve goes on where it left.
        low = s - 1
        px, py = a["x"].bitwiseAND(low), a["y"].bitwiseAND(low)
        fx, fy = F.when(rx == 1, low - px).otherwise(px), F.when(rx == 1, low - py).otherwise(py)
        return F.struct(F.when(ry == 0, fy).otherwise(px).alias("x"), F.when(ry == 0, fx).otherwise(py).alias("y"), (a["d"] + add).alias("d"))

    steps = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, -1, -1)])
    return F.aggregate(steps, state, step)["d"]


def scaled(v: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """Cell of a value between two bounds on a 2**bits axis."""
    top = (1 << bits) - 1
    return F.when(high > low, F.least(F.greatest(F.floor((v - low) / (high - low) * top), F.lit(0)), F.lit(top))).otherwise(0).cast("long")


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * 6378137.0


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * 6378137.0


def longitude(x: Column) -> Column:
    return F.degrees(x / 6378137.0)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / 6378137.0)) - F.lit(math.pi / 2))


def tile_resolution(zoom: Column) -> Column:
    return F.lit(2 * WORLD / TILE) / F.pow(F.lit(2.0), zoom)


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Web-Mercator bounds of a tile."""
    side = F.lit(2 * WORLD) / F.pow(F.lit(2.0), z)
    return F.struct((x * side - WORLD).alias("xmin"), (F.lit(WORLD) - (y + 1) * side).alias("ymin"), ((x + 1) * side - WORLD).alias("xmax"), (F.lit(WORLD) - y * side).alias("ymax"))


def is_projected(wkt: Column) -> Column:
    return wkt.contains("PROJCRS") | wkt.contains("PROJCS")


def cell_centres(gt: Column, rows: Column, cols: Column) -> Column:
    """(axis, place, centre) of each column and row of a grid; null where it is rotated, since no axis says where its cells are then."""
    along = lambda axis, first, step, n: F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda k: F.struct(F.lit(axis).alias("axis"), k.alias("place"), (first + (k + 0.5) * step).alias("centre")))
    return F.when((gt[2] == 0) & (gt[4] == 0) & (rows > 0) & (cols > 0), F.concat(along("x", gt[0], gt[1], cols), along("y", gt[3], gt[5], rows)))
