"""Point clouds: finite points, octree nodes level by level, node layout, box queries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import free_name
from quarry.operators.ladders import small
from quarry.operators.spatial import MOST_BOXES

MOST_DEPTH = 21
#: Points of a node whose subtree one task works out: some 20 MB.
LOCAL = 200_000
POINT_BYTES = 24


def finite(points: DataFrame) -> DataFrame:
    """Points all of whose coordinates are finite."""
    ok = F.lit(True)
    for c in ("x", "y", "z"):
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(ok)


def root_cube(points: DataFrame) -> tuple[float, float, float, float]:
    """Lower corner and side: the largest extent, 1 where there is none."""
    e = points.agg(*[f(c).cast("double") for f in (F.min, F.max) for c in ("x", "y", "z")]).first()
    if e[0] is None:
        raise ValueError("no points")
    return e[0], e[1], e[2], max(e[3] - e[0], e[4] - e[1], e[5] - e[2]) or 1.0


def voxel(cube: tuple[float, float, float, float], span: int) -> Column:
    """Cell of a point in a span**3 grid over the root cube, clipped to it."""
    x0, y0, z0, side = cube
    cell = lambda c, low: F.least(F.floor((F.col(c) - low) / side * span), F.lit(span - 1)).cast("long")
    return (cell("x", x0) * span + cell("y", y0)) * span + cell("z", z0)


def voxel_representatives(points: DataFrame, span: int) -> DataFrame:
    """(cell, pid): the first point of each occupied cell of the root's grid."""
    return points.groupBy(voxel(root_cube(points), span).alias("cell")).agg(F.min("pid").alias("pid"))


PLACED = "row long, pid long, depth int, nx long, ny long, nz long"


def _finished(points: pa.Table, depth: int, cube: tuple[float, float, float, float], span: int, most_depth: int) -> pa.Table:
    """PLACED rows of all points of some nodes of a depth, and of the nodes below them, level by level in numpy."""
    of = {c: points[c].to_numpy() for c in ("row", "pid", "x", "y", "z", "nx", "ny", "nz")}
    low, size, out = cube[:3], cube[3] / 2**depth, []
    while len(of["row"]):
        cells = [np.minimum(np.floor((of[c] - (x0 + of[n] * size)) / size * span), span - 1).astype(np.int64) for c, n, x0 in zip("xyz", ("nx", "ny", "nz"), low, strict=True)]
        cell = (cells[0] * span + cells[1]) * span + cells[2]
        keys = (of["row"], of["pid"], cell, of["nz"], of["ny"], of["nx"])
        order = np.lexsort(keys)
        moved = lambda ks: np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in ks], axis=0)])  # noqa: B023, E731
        begins = np.flatnonzero(moved(keys[3:]))
        n = np.repeat(np.diff(np.append(begins, len(order))), np.diff(np.append(begins, len(order))))
        kept = np.zeros(len(order), bool)
        kept[order] = moved(keys[2:]) | (n <= span**3) | (depth == most_depth)
        out.append(pa.table({**{c: of[c][kept] for c in ("row", "pid")}, "depth": np.full(int(kept.sum()), depth, np.int32), **{c: of[c][kept] for c in ("nx", "ny", "nz")}}))
        for c, k, x0 in zip("xyz", ("nx", "ny", "nz"), low, strict=True):
            of[k] = 2 * of[k] + (of[c] >= x0 + of[k] * size + size / 2)
        of = {c: v[~kept] for c, v in of.items()}
        depth, size = depth + 1, size / 2
    return pa.concat_tables(out)


def _placed(points: DataFrame, row: str, cube: tuple[float, float, float, float], span: int, most_depth: int, cut, local: int) -> DataFrame:
    """(row, pid, depth, nx, ny, nz) of points (row, pid, x, y, z), which are told apart by their row.

    Nodes of more than ``local`` points are split over all tasks, a level at a time; a
    smaller one goes to one task with its points, which finishes all that lies below it.
    """
    x0, y0, z0, side = cube
    key = ["nx", "ny", "nz"]
    left = points.select(F.col(row).cast("long").alias("row"), F.col("pid").cast("long").alias("pid"), "x", "y", "z", *[F.lit(0).cast("long").alias(n) for n in key])
    out, pending, size = [], [], side
    for depth in range(most_depth + 1):
        large = None
        if depth < most_depth:
            # No more than the points over ``local``.
            large = cut(left.groupBy(*key).agg(F.count("*").alias("in_node")).where(F.col("in_node") > max(local, span**3)), f"octree-nodes-{depth}").select(*key)
            large = None if large.isEmpty() else small(large)
        few = left if large is None else left.join(large, key, "left_anti")
        if depth == most_depth or span**3 >= local:  # these are whole
            out.append(few.select("row", "pid", F.lit(depth).alias("depth"), *key))
        else:
            pending.append(few.withColumn("depth", F.lit(depth)))
        if large is None:
            break
        cell = lambda c, n, low, s=size: F.least(F.floor((F.col(c) - (F.lit(low) + F.col(n) * s)) / s * span), F.lit(span - 1)).cast("long")
        split = left.join(large, key, "left_semi").withColumn("cell", (cell("x", "nx", x0) * span + cell("y", "ny", y0)) * span + cell("z", "nz", z0))
        first = split.groupBy(*key, "cell").agg(F.min(F.struct("pid", "row")).alias("first")).select(*key, "cell", F.col("first.row").alias("first_row"))
        marked = cut(split.join(first, [*key, "cell"]).withColumn("kept", F.col("row") == F.col("first_row")).drop("cell", "first_row"), f"octree-{depth}")
        out.append(marked.where("kept").select("row", "pid", F.lit(depth).alias("depth"), *key))
        rest, half = marked.where("not kept"), size / 2
        child = lambda c, n, low, s=size, h=half: (2 * F.col(n) + (F.col(c) >= F.lit(low) + F.col(n) * s + h).cast("long")).alias(n)
        left, size = rest.select("row", "pid", "x", "y", "z", child("x", "nx", x0), child("y", "ny", y0), child("z", "nz", z0)), half

    def finish(at: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _finished(rows, at[0].as_py(), cube, span, most_depth)

    if pending:
        out.append(reduce(DataFrame.unionByName, pending).groupBy("depth", *key).applyInArrow(finish, PLACED))
    return reduce(DataFrame.unionByName, out)


def _numbered_rows(points: DataFrame, row: str, cut) -> DataFrame:
    """Finite points with a number each, written, so that the numbers stay."""
    whole = finite(points)
    return cut(whole.withColumns({row: F.monotonically_increasing_id(), **{c: F.col(c).cast("double") for c in "xyz"}}), "octree-points")


def octree(points: DataFrame, span: int = 128, most_depth: int = MOST_DEPTH, checkpoint=None, local: int = LOCAL) -> DataFrame:
    """(pid, depth, node) of every point, each in one node.

    Level by level: a node of at most span**3 points, or at the greatest depth, keeps
    them all; another keeps the first point of each voxel and hands the rest to its
    octants.  ``checkpoint`` (a function of DataFrame and name) cuts the lineage of a
    level; by default ``DataFrame.checkpoint`` does.  What lies below a node of at most
    ``local`` points is worked out by one task.
    """
    cut = checkpoint or (lambda df, name: df.checkpoint())
    points = finite(points).select("pid", "x", "y", "z")
    cube = root_cube(points)
    placed = _placed(_numbered_rows(points, "row", cut), "row", cube, span, most_depth, cut, local)
    return placed.select("pid", "depth", F.concat_ws("-", "depth", "nx", "ny", "nz").alias("node"))


def node_layout(nodes: DataFrame) -> DataFrame:
    """(depth, nodes, points, largest node) of each depth."""
    each = nodes.groupBy("depth", "node").agg(F.count("*").alias("n"))
    return each.groupBy("depth").agg(F.count("*").alias("nodes"), F.sum("n").alias("points"), F.max("n").alias("max_node_points"))


def _asked(points: DataFrame, boxes: list[tuple], axes: str) -> DataFrame:
    """(query, point columns) of few boxes (query, low corner, high corner); what lies outside the box about all of them is dropped by plain comparisons, which reach the scan."""
    if len(boxes) > MOST_BOXES:
        raise ValueError(f"more than {MOST_BOXES} query boxes")
    n = len(axes)
    if not boxes:
        return points.withColumn("query", F.lit(0)).limit(0)
    for k, c in enumerate(axes, 1):
        points = points.where((F.col(c) >= min(b[k] for b in boxes)) & (F.col(c) <= max(b[k + n] for b in boxes)))
    inside = [F.when(reduce(and_, [F.col(c).between(b[k], b[k + n]) for k, c in enumerate(axes, 1)]), F.lit(b[0])) for b in boxes]
    return points.withColumn("query", F.explode(F.filter(F.array(*inside), lambda q: q.isNotNull())))


def in_box(points: DataFrame, boxes: list[tuple[int, float, float, float, float]]) -> DataFrame:
    """Points in each of few boxes (query, x0, y0, x1, y1) over the full height, borders included."""
    return _asked(points, boxes, "xy")


def in_cube(points: DataFrame, cubes: list[tuple[int, float, float, float, float, float, float]]) -> DataFrame:
    """Points in each of few boxes (query, x0, y0, z0, x1, y1, z1), borders included."""
    return _asked(points, cubes, "xyz")


#: Columns that tell where a written point lies; a point column of one of these names is refused.
PLACE = ("octree_part", "octree_node")
#: Nodes from this depth on are stored with their ancestor there, so a depth has at most 8 ** 2 folders.
FOLDER_DEPTH = 2


def _part(depth: str, key: tuple[str, str, str]) -> Column:
    """Folder of a node: its depth, and the octants of its ancestor."""
    level = F.least(F.col(depth), F.lit(FOLDER_DEPTH))
    octants = F.lit(0).cast("long")
    for c in key:
        octants = octants * (1 << FOLDER_DEPTH) + F.expr(f"shiftright({c}, {depth} - least({depth}, {FOLDER_DEPTH}))")
    return (F.col(depth) * 100 + F.when(level > 0, octants).otherwise(0)).cast("int")


def write_octree(points: DataFrame, path: str, span: int = 128, most_depth: int = MOST_DEPTH, checkpoint=None, local: int = LOCAL) -> None:
    """Points with all their columns in folders of ``points`` by depth and place, in node order, and a table ``nodes`` of the nodes with the boxes about their points.

    Every finite point is written once, points of one pid or equal points too.
    """
    if clash := set(PLACE) & {c.lower() for c in points.columns}:
        raise ValueError(f"points have columns that the octree writes: {sorted(clash)}")
    if checkpoint is None:
        from quarry.plans.tables import written as checkpoint
    row = free_name(points, "octree_row")
    own = _numbered_rows(points, row, checkpoint)
    cube = root_cube(own)
    at = checkpoint(_placed(own, row, cube, span, most_depth, checkpoint, local), "octree-placed")
    node = F.concat_ws("-", "depth", "nx", "ny", "nz").alias(PLACE[1])
    where = at.select(F.col("row").alias(row), node, _part("depth", ("nx", "ny", "nz")).alias(PLACE[0]))
    placed = own.join(where, row).drop(row)
    placed.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).write.partitionBy(PLACE[0]).mode("overwrite").parquet(f"{path}/points")
    kept = points.sparkSession.read.parquet(f"{path}/points")
    boxes = [f(c).alias(f"{name}{c}") for name, f in (("min_", F.min), ("max_", F.max)) for c in "xyz"]
    kept.groupBy(*PLACE).agg(F.count("*").alias("points"), *boxes).withColumn("depth", F.substring_index(PLACE[1], "-", 1).cast("int")).write.mode("overwrite").parquet(f"{path}/nodes")


def octree_boxes(spark, path: str, cubes: list[tuple[int, float, float, float, float, float, float]]) -> DataFrame:
    """Points of a written octree in each of few boxes (query, x0, y0, z0, x1, y1, z1), borders included.

    Nodes are chosen first, by the boxes about their points; only folders with a chosen
    node are read, and in them only chosen nodes go on to the comparison with the boxes.
    """
    nodes = spark.read.parquet(f"{path}/nodes")
    spans = nodes.select(*PLACE, *[F.struct(F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high")).alias(c) for c in "xyz"])
    meets = [reduce(and_, [(F.col(f"{c}.low") <= b[k + 3]) & (F.col(f"{c}.high") >= b[k]) for k, c in enumerate("xyz", 1)]) for b in cubes]
    chosen = spans.where(reduce(or_, meets)).select(*PLACE) if cubes else spans.select(*PLACE).limit(0)
    # Depths times 64 folders at most, whatever the number of nodes.
    parts = [r[0] for r in chosen.select(PLACE[0]).distinct().collect()]
    points = spark.read.parquet(f"{path}/points").where(F.col(PLACE[0]).isin(parts))
    return in_cube(points.join(chosen.select(PLACE[1]), PLACE[1], "left_semi"), cubes).drop(*PLACE)


def pick_column(points: DataFrame, names: list[str]) -> str:
    """The table's column for the first of several names that it has in any case."""
    have = {c.lower(): c for c in points.columns}
    found = [have[n.lower()] for n in names if n.lower() in have]
    if not found:
        raise KeyError(f"none of {names} is a column; there are {points.columns}")
    return found[0]


def carried(points: DataFrame, geometry: list[str], include: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
    """Columns that travel with the points: all but the geometry, or those of a list that exist, in its order; less the excluded ones."""
    own = [c for c in points.columns if c not in geometry]
    return [c for c in (own if include is None else include) if c in own and c not in exclude]


def short_names(names: list[str], longest: int = 32) -> dict[str, str]:
    """Names cut to a length that a format allows; where two would be equal, a number takes the last places."""
    out, taken = {}, set()
    for name in names:
        tried = (name[:longest] if not k else f"{name[: longest - len(str(k)) - 1]}_{k}" for k in range(len(names)))
        out[name] = next(x for x in tried if x not in taken)
        taken.add(out[name])
    return out
