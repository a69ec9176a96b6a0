"""Display tiles of a table of grids: pixel windows, pyramid level, chunks touched, the best tiles, sessions.

A grid is a row: ``grid`` (its name), ``affine`` (a, b, c, d, e, f: x = a col + b row + c,
y = d col + e row + f, turned or sheared as it may be), ``rows``, ``cols``, ``block_rows``,
``block_cols``, ``decimations`` (of its levels, 1 among them) and ``crs`` (EPSG:3857, or
EPSG:4326 in degrees).  Tiles are those of the web-Mercator square, and all grids are
gone through in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.grid import WORLD, blocks_spanned, bounds, latitude, longitude, mercator_x, mercator_y, tile_bounds, tile_resolution

MOST_ZOOM = 24
#: A tile's resolution is a grid's own, if they are this near to each other.
NEAR = 1e-8
#: Parts of the Mercator square end here.
MOST_LATITUDE = 85.0511287798066
#: Targets of so many chunks or more are open: the smallest larger number serves them.
OPEN_FROM = 9
TARGETS = (1, 2, 4, 9)
#: A pixel may be off by so much at a window that still counts as inside.
SLACK = 0.5


def pick_decimation(decimations: Column | Sequence[int], native: Column, wanted: Column) -> Column:
    """Largest decimation whose pixels are no larger than wanted, else the smallest."""
    all_of = decimations if isinstance(decimations, Column) else F.array(*[F.lit(d) for d in decimations])
    return F.coalesce(F.array_max(F.filter(all_of, lambda d: native * d <= wanted)), F.array_min(all_of))


def zoom_for(resolution: Column) -> Column:
    """The zoom whose resolution is nearest to one, by ratio; a tie goes to the finer zoom."""
    at = lambda z: tile_resolution(z)
    near = lambda z: F.abs(resolution - at(z)) / at(z) <= NEAR
    first = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(MOST_ZOOM)), lambda z: (resolution > at(z)) | near(z))), F.lit(MOST_ZOOM))
    coarser = (first > 0) & ~near(first) & (at(first - 1) / resolution < resolution / at(first))
    return F.when(coarser, first - 1).otherwise(first)


def located(grids: DataFrame) -> DataFrame:
    """Grids with ``box`` (their bounds in Mercator metres), ``native`` (their pixel size in their own units), ``native_metres`` and ``native_zoom``; an unknown system of coordinates is an error."""
    known = F.col("crs").isin("EPSG:3857", "EPSG:4326")
    checked = F.when(known, F.col("crs")).otherwise(F.raise_error(F.format_string("grid %s has coordinates in %s, which has no closed form here", F.col("grid").cast("string"), "crs")).cast("string"))
    a = F.col("affine")
    own = bounds(F.array(a[2], a[0], a[1], a[5], a[3], a[4]), F.col("rows"), F.col("cols"))
    degrees = F.col("crs") == "EPSG:4326"
    y = lambda v: mercator_y(F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), v)))
    box = F.struct(*[F.when(degrees, f(own[k])).otherwise(own[k]).alias(k) for k, f in (("xmin", mercator_x), ("ymin", y), ("xmax", mercator_x), ("ymax", y))])
    out = grids.withColumn("crs", checked).withColumn("box", box).withColumns({"native": F.abs(a[0]), "native_metres": (F.col("box.xmax") - F.col("box.xmin")) / F.col("cols")})
    return out.withColumn("native_zoom", zoom_for(F.col("native_metres")))


def tiles_of(grids: DataFrame) -> DataFrame:
    """Located grids with a zoom ``z`` each, once for every tile (x, y) of it that their bounds reach.

    Columns of tiles are dealt anew before their rows are listed, so a large grid isn't one task's.
    """
    side = F.lit(2 * WORLD) / F.pow(F.lit(2.0), "z")
    last = F.pow(F.lit(2.0), "z").cast("long") - 1
    place = lambda v: F.greatest(F.lit(0).cast("long"), F.least(last, F.floor(v / side).cast("long")))
    x = F.sequence(place(F.col("box.xmin") + WORLD), place(F.col("box.xmax") + WORLD))
    y = F.sequence(place(F.lit(WORLD) - F.col("box.ymax")), place(F.lit(WORLD) - F.col("box.ymin")))
    return grids.withColumn("x", F.explode(x)).repartition("grid", "z", "x").withColumn("y", F.explode(y))


def _once(value: Column, then) -> Column:
    """A function of a value that is worked out once, however often the function names it."""
    return F.transform(F.array(value), then)[0]


def pixel_window(z: Column, x: Column, y: Column) -> Column:
    """Window of a tile in pixels of its row's grid, from the tile's four corners through the inverse of the affine: clipped, null if disjoint, and whether all of the tile is inside."""
    a, degrees = F.col("affine"), F.col("crs") == "EPSG:4326"
    area = a[0] * a[4] - a[1] * a[3]

    def corners(b: Column) -> Column:
        us = [F.when(degrees, longitude(b[k])).otherwise(b[k]) - a[2] for k in ("xmin", "xmax")]
        vs = [F.when(degrees, latitude(b[k])).otherwise(b[k]) - a[5] for k in ("ymin", "ymax")]
        return _once(F.struct(*[u.alias(f"u{k}") for k, u in enumerate(us)], *[v.alias(f"v{k}") for k, v in enumerate(vs)]), places)

    def places(t: Column) -> Column:
        at = [(t[u], t[v]) for u in ("u0", "u1") for v in ("v0", "v1")]
        cols, rows = F.array(*[(a[4] * u - a[1] * v) / area for u, v in at]), F.array(*[(a[0] * v - a[3] * u) / area for u, v in at])
        return _once(F.struct(cols.alias("cols"), rows.alias("rows")), lambda p: _once(F.struct(F.array_min(p["cols"]).alias("c0"), F.array_max(p["cols"]).alias("c1"), F.array_min(p["rows"]).alias("r0"), F.array_max(p["rows"]).alias("r1")), clipped))

    def clipped(p: Column) -> Column:
        inside = (p["c0"] >= -SLACK) & (p["c1"] <= F.col("cols") + SLACK) & (p["r0"] >= -SLACK) & (p["r1"] <= F.col("rows") + SLACK)
        c0, r0 = (F.greatest(p[k], F.lit(0.0)) for k in ("c0", "r0"))
        c1, r1 = (F.least(p[k], F.col(n).cast("double")) for k, n in (("c1", "cols"), ("r1", "rows")))
        return F.when((c1 > c0) & (r1 > r0), F.struct(c0.alias("c0"), r0.alias("r0"), c1.alias("c1"), r1.alias("r1"), inside.alias("interior")))

    return _once(tile_bounds(z, x, y), corners)


def chunk_count(window: Column, block: Column, decimation: Column, block_cols: Column | None = None) -> Column:
    """Chunks that a window touches at a decimation; 0 off the raster."""
    across = block if block_cols is None else block_cols
    span = lambda a, b, n: blocks_spanned(window[a] / decimation, window[b] / decimation, n)
    return F.when(window.isNull(), F.lit(0).cast("long")).otherwise(span("c0", "c1", across) * span("r0", "r1", block))


def counted(tiles: DataFrame, decimation: Column, *keep: str) -> DataFrame:
    """(grid, keep, z, x, y, decimation, interior, chunks) of the tiles that overlap their grid."""
    # Tiles without a window go where windows are unpacked: a filter would work each window out anew.
    window = F.filter(F.array(pixel_window(F.col("z"), F.col("x"), F.col("y"))), lambda w: w.isNotNull())
    seen = tiles.select("grid", *keep, "z", "x", "y", "block_rows", "block_cols", decimation.alias("decimation"), F.explode(window).alias("window"))
    return seen.select("grid", *keep, "z", "x", "y", "decimation", F.col("window.interior").alias("interior"), chunk_count(F.col("window"), F.col("block_rows"), F.col("decimation"), F.col("block_cols")).alias("chunks"))


def zoom_tiles(grids: DataFrame, zooms: Column) -> DataFrame:
    """Counted tiles of each grid at an array of zooms, at the level that a viewer would read."""
    at = tiles_of(located(grids).withColumn("z", F.explode(zooms)))
    return counted(at, pick_decimation(F.col("decimations"), F.col("native_metres"), tile_resolution(F.col("z"))))


def best_tiles(tiles: DataFrame, targets: Sequence[int] = TARGETS, open_from: int = OPEN_FROM) -> DataFrame:
    """(grid, target, chunks, z, x, y, interior, approximate): of each grid a tile for each target number of chunks that one has.

    A target from ``open_from`` on that no tile has is served by the smallest larger
    number.  Of each grid zooms count from the finest on, no further than where all
    targets are served; of the tiles of one number the first that is wholly inside goes
    first, else the first, by zoom, column and row.  The tiles are gone through once, for
    the best of each grid, zoom and number; all else is worked out from these few.
    """
    serves = F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: (F.col("chunks") == t) | ((t >= open_from) & (F.col("chunks") >= t)))
    first = tiles.groupBy("grid", "z", "chunks").agg(F.min_by(F.struct("x", "y", "interior"), F.struct(~F.col("interior"), "x", "y")).alias("t"))
    met = first.select("grid", "z", F.explode(serves).alias("target")).groupBy("grid", "target").agg(F.max("z").alias("z"))
    stop = met.groupBy("grid").agg(F.when(F.count("*") == len(set(targets)), F.min("z")).otherwise(0).alias("stop"))
    seen = first.join(stop, "grid").where(F.col("z") >= F.col("stop")).select("grid", "chunks", "z", "t.*")
    best = seen.groupBy("grid", "chunks").agg(F.min_by(F.struct("z", "x", "y", "interior"), F.struct(~F.col("interior"), -F.col("z"), "x", "y")).alias("t"))
    served = best.select("grid", "chunks", "t", F.explode(serves).alias("target")).groupBy("grid", "target").agg(F.min_by(F.struct("chunks", "t"), "chunks").alias("b"))
    return served.select("grid", "target", "b.chunks", "b.t.*", (F.col("b.chunks") != F.col("target")).alias("approximate"))


def chunk_tiles(grids: DataFrame, targets: Sequence[int] = TARGETS) -> DataFrame:
    """The best tile of each grid for each target number of chunks, from the grid's own zoom to four beyond its coarsest level."""
    coarsest = F.greatest(F.lit(0), F.col("native_zoom") - F.size("decimations") - 4)
    return best_tiles(zoom_tiles(grids, F.sequence(F.col("native_zoom"), coarsest)), targets)


def resolution_tiles(grids: DataFrame, wanted: Sequence[float] | None = None) -> DataFrame:
    """(grid, wanted, decimation, z, x, y, interior, chunks): of each grid and wanted resolution, in the grid's own units, its level, its zoom, and the first tile there that is wholly inside, else the first that overlaps.  Where none is wanted each level's own resolution is."""
    own = F.transform("decimations", lambda d: F.col("native") * d)
    asked = F.array(*[F.lit(float(w)) for w in wanted]) if wanted else own
    at = located(grids).withColumn("wanted", F.explode(asked)).withColumn("z", zoom_for(F.col("wanted") * F.col("native_metres") / F.col("native")))
    seen = counted(tiles_of(at), pick_decimation(F.col("decimations"), F.col("native"), F.col("wanted")), "wanted")
    best = seen.groupBy("grid", "wanted", "z", "decimation").agg(F.min_by(F.struct("x", "y", "interior", "chunks"), F.struct(~F.col("interior"), "x", "y")).alias("t"))
    return best.select("grid", "wanted", "decimation", "z", "t.*")


def sessions(grids: DataFrame, steps_in: int = 3, steps_out: int = 2) -> DataFrame:
    """(grid, step, action, z, x, y, decimation, chunks) of a look at each grid: from ``steps_in`` zooms above its own in on its centre, a tile east, south, west and north, and out again; no chunks where a tile is off the grid."""
    own = located(grids)
    lon = (longitude(F.col("box.xmin")) + longitude(F.col("box.xmax"))) / 2
    lat = (latitude(F.col("box.ymin")) + latitude(F.col("box.ymax"))) / 2
    begin = F.greatest(F.lit(0), F.col("native_zoom") - steps_in)
    own = own.withColumns({"u": mercator_x(lon) + WORLD, "v": F.lit(WORLD) - mercator_y(lat), "begin": begin}).withColumn("deep", F.least(F.lit(MOST_ZOOM), F.col("begin") + steps_in))
    at = lambda v, z: F.floor(v / (F.lit(2 * WORLD) / F.pow(F.lit(2.0), z))).cast("long")
    step = lambda action, z, x, y: F.struct(action.alias("action"), z.alias("z"), x.alias("x"), y.alias("y"))
    u, v, deep = F.col("u"), F.col("v"), F.col("deep")
    inward = F.transform(F.sequence(F.col("begin"), deep), lambda z: step(F.when(z == F.col("begin"), "start").otherwise("zoom_in"), z, at(u, z), at(v, z)))
    x, y = at(u, deep), at(v, deep)
    around = F.array(step(F.lit("pan_e"), deep, x + 1, y), step(F.lit("pan_s"), deep, x + 1, y + 1), step(F.lit("pan_w"), deep, x, y + 1), step(F.lit("pan_n"), deep, x, y))
    outward = F.transform(F.filter(F.sequence(F.lit(0), F.least(F.lit(steps_out), deep)), lambda k: k > 0), lambda k: step(F.lit("zoom_out"), deep - k, F.floor(x / F.pow(F.lit(2.0), k)).cast("long"), F.floor(y / F.pow(F.lit(2.0), k)).cast("long")))
    each = own.select("*", F.posexplode(F.concat(inward, around, outward)).alias("step", "s")).select("*", "s.*")
    window = pixel_window(F.col("z"), F.col("x"), F.col("y"))
    decimation = pick_decimation(F.col("decimations"), F.col("native"), tile_resolution(F.col("z")))
    each = each.withColumns({"window": window, "decimation": decimation})
    return each.select("grid", "step", "action", "z", "x", "y", "decimation", chunk_count(F.col("window"), F.col("block_rows"), F.col("decimation"), F.col("block_cols")).alias("chunks"))


def scenarios(grids: DataFrame, targets: Sequence[int] = TARGETS, wanted: Sequence[float] | None = None) -> DataFrame:
    """All tiles to be timed, by name: (grid, label, z, x, y, chunks, approximate, decimation) of the best tiles, the resolutions and the session; what a kind has no word for is null."""
    chunks = chunk_tiles(grids, targets).select("grid", F.concat(F.col("target").cast("string"), F.lit("chunk")).alias("label"), "z", "x", "y", "chunks", "approximate")
    levels = resolution_tiles(grids, wanted).select("grid", F.format_string("res_%sm", F.regexp_replace(F.format_string("%.6f", "wanted"), r"\.?0+$", "")).alias("label"), "z", "x", "y", "chunks", "decimation")
    looks = sessions(grids).select("grid", F.format_string("pan_zoom_%02d_%s", "step", "action").alias("label"), "z", "x", "y", "chunks", "decimation")
    return chunks.unionByName(levels, allowMissingColumns=True).unionByName(looks, allowMissingColumns=True).withColumn("approximate", F.coalesce("approximate", F.lit(False)))
