"""A packed Hilbert R-tree as tables: features in curve order, node boxes level by level, queries that descend.

Level 0 holds the leaves, each about ``node_size`` features that follow one another on the
curve; a node of the next level is about ``node_size`` nodes of the one below.  The first
children of node k of any level are numbered k * node_size, so no pointers are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import free_names
from quarry.operators.order import numbered
from quarry.operators.spatial import BOX, MOST_BOXES, drop_null, spread, with_curve

NODE_SIZE = 16
#: Columns that tell where a written feature lies; a feature column of one of these names is refused.
PLACE = ("rtree_page", "rtree_leaf")
#: Pages are the nodes of the lowest level that has no more than so many.
MOST_PAGES = 64
BYTES = 40


def depth_of(features: int, node_size: int) -> int:
    """Levels of nodes over so many features, the root's included."""
    depth, nodes = 0, features
    while depth == 0 or nodes > 1:
        depth, nodes = depth + 1, -(-nodes // node_size)
    return depth


def page_level(features: int, node_size: int) -> int:
    """The level whose nodes are pages."""
    level, nodes = 0, -(-features // node_size)
    while nodes > MOST_PAGES:
        level, nodes = level + 1, -(-nodes // node_size)
    return level


def in_order(features: DataFrame, ties: Sequence[str] = (), name: str = "place", cut=None) -> DataFrame:
    """Features that have a geometry with their place along the curve from 0; features at one point of it go by ``ties``."""
    if cut is None:
        from quarry.plans.tables import written as cut
    curve, row = free_names(features, "rtree_curve", "rtree_row")
    own = drop_null(features).withColumn(row, F.monotonically_increasing_id())
    own = cut(with_curve(spread(own), name=curve), "rtree-features")
    return numbered(own, [curve, *ties, row], name=name, cut=cut).drop(curve, row)


def node_table(placed: DataFrame, node_size: int = NODE_SIZE, place: str = "place", cut=None) -> DataFrame:
    """(level, node, children, xmin, ymin, xmax, ymax) of all levels over features with their places; each level is made from the written one below it."""
    if cut is None:
        from quarry.plans.tables import written as cut
    box = [F.min(c).alias(c) for c in BOX[:2]] + [F.max(c).alias(c) for c in BOX[2:]]
    below, out = placed.select(F.col(place).alias("node"), *BOX), None
    for level in range(depth_of(placed.count(), node_size)):
        below = cut(below.groupBy(F.expr(f"node div {node_size}").alias("node")).agg(F.count("*").alias("children"), *box), f"rtree-{level}")
        one = below.select(F.lit(level).alias("level"), "node", "children", *BOX)
        out = one if out is None else out.unionByName(one)
    return out


def write_rtree(features: DataFrame, path: str, node_size: int = NODE_SIZE, ties: Sequence[str] = (), cut=None) -> None:
    """Features with all their columns in pages below ``features``, in curve order, and the nodes of each level below ``nodes``.  Features without geometry aren't indexed."""
    if clash := set(PLACE) & {c.lower() for c in features.columns}:
        raise ValueError(f"features have columns that the tree writes: {sorted(clash)}")
    (place,) = free_names(features, "rtree_place")
    placed = in_order(features, ties, place, cut)
    if cut is None:
        from quarry.plans.tables import written as cut
    placed = cut(placed, "rtree-places")
    level = page_level(placed.count(), node_size)
    leaf = F.expr(f"{place} div {node_size}")
    paged = placed.withColumns({PLACE[1]: leaf, PLACE[0]: F.expr(f"{place} div {node_size ** (level + 1)}").cast("int")})
    paged.repartitionByRange(PLACE[0], place).sortWithinPartitions(PLACE[0], place).drop(place).write.partitionBy(PLACE[0]).mode("overwrite").parquet(f"{path}/features")
    node_table(placed, node_size, place, cut).write.partitionBy("level").mode("overwrite").parquet(f"{path}/nodes")


def _meets(b: Sequence[float]) -> Column:
    """Closed overlap with one box (query, x0, y0, x1, y1)."""
    return (F.col("xmin") <= b[3]) & (F.col("xmax") >= b[1]) & (F.col("ymin") <= b[4]) & (F.col("ymax") >= b[2])


def _hit(rows: DataFrame, boxes: list[tuple]) -> DataFrame:
    """(query, columns of rows) for each box that a row meets; the box about all of them is a plain filter."""
    about = ("", *(f(b[k] for b in boxes) for k, f in ((1, min), (2, min), (3, max), (4, max))))
    hits = F.filter(F.array(*[F.when(_meets(b), F.lit(b[0])) for b in boxes]), lambda q: q.isNotNull())
    return rows.where(_meets(about)).select(F.explode(hits).alias("query"), *rows.columns)


def descend(nodes: DataFrame, boxes: list[tuple], node_size: int = NODE_SIZE) -> DataFrame:
    """(query, node) of the leaves whose boxes meet each query box, from the root down: of each level only children of nodes that were met are looked at."""
    depth = nodes.agg(F.max("level")).first()[0]
    met = None
    for level in range(-1 if depth is None else depth, -1, -1):
        here = _hit(nodes.where(F.col("level") == level).select("node", *BOX), boxes)
        if met is not None:
            here = here.withColumn("parent", F.expr(f"node div {node_size}")).join(met.withColumnRenamed("node", "parent"), ["query", "parent"], "left_semi")
        met = here.select("query", "node")
    return met if met is not None else nodes.select(F.lit(0).alias("query"), "node").limit(0)


def overlapping(spark, path: str, boxes: list[tuple[int, float, float, float, float]], node_size: int = NODE_SIZE) -> DataFrame:
    """(query, feature columns) of a written tree's features that meet each of few query boxes, borders included.

    Pages without a leaf that was met aren't read; in the others a feature goes on only if its leaf was met.
    """
    if len(boxes) > MOST_BOXES:
        raise ValueError(f"more than {MOST_BOXES} query boxes")
    features = spark.read.parquet(f"{path}/features")
    if not boxes:
        return features.drop(*PLACE).withColumn("query", F.lit(0)).limit(0)
    nodes = spark.read.parquet(f"{path}/nodes")
    leaves = descend(nodes, boxes, node_size)
    level = page_level(nodes.where("level = 0").agg(F.sum("children")).first()[0] or 0, node_size)
    per_page = node_size**level
    met = leaves.select(F.col("query").alias("asked"), F.col("node").alias(PLACE[1]), F.expr(f"node div {per_page}").cast("int").alias("page"))
    # Pages that were met, each with the leaves between which it is read: no more rows than there are pages.
    ranges = met.groupBy("page").agg(F.min(PLACE[1]).alias("low"), F.max(PLACE[1]).alias("high")).collect()
    near = features.where(F.col(PLACE[0]).isin([r.page for r in ranges]))
    if ranges:
        near = near.where(reduce(or_, [F.col(PLACE[1]).between(r.low, r.high) for r in ranges]))
    asked = near.join(met.select("asked", PLACE[1]), PLACE[1])
    exact = reduce(or_, [(F.col("asked") == b[0]) & _meets(b) for b in boxes])
    around = reduce(and_, [F.col("xmin") <= max(b[3] for b in boxes), F.col("xmax") >= min(b[1] for b in boxes), F.col("ymin") <= max(b[4] for b in boxes), F.col("ymax") >= min(b[2] for b in boxes)])
    return asked.where(around & exact).select(F.col("asked").alias("query"), *[c for c in features.columns if c not in PLACE])
