"""The packed R-tree: the same rows as plain comparison, boxes that hold their children, few pages read, bytes as the formula has them."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import grid
from quarry.operators import rtree, spatial


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(3)
    rows = [(k, *[(x := rng.uniform(-50, 50)), (y := rng.gauss(0, 20)), x + rng.random(), y + rng.random()][:4], f"c{k}", k % 5) for k in range(700)]
    rows += [(k, 1.0, 1.0, 2.0, 2.0, "tie", 0) for k in range(1000, 1040)] + [(2000, None, None, None, None, "none", 1)]
    return spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double, curve string, place int")


def test_levels(spark, features):
    placed = rtree.in_order(features, ["id"], "at")
    assert placed.columns == [*features.columns, "at"] and sorted(r.at for r in placed.collect()) == list(range(740))
    nodes = rtree.node_table(placed, 4, "at")
    rows = {(r.level, r.node): r for r in nodes.collect()}
    sizes = [740, 185, 47, 12, 3, 1]
    assert [sum(k[0] == level for k in rows) for level in range(5)] == sizes[1:] and rtree.depth_of(740, 4) == 5
    assert [sum(r.children for k, r in rows.items() if k[0] == level) for level in range(5)] == sizes[:-1]
    for (level, node), r in rows.items():
        if (up := rows.get((level + 1, node // 4))) is not None:
            assert up.xmin <= r.xmin and up.ymin <= r.ymin and up.xmax >= r.xmax and up.ymax >= r.ymax
    # As many nodes as the size formula charges, features being its lowest level.
    charged = spark.range(1).select(grid.index_bytes(F.lit(740), F.lit(4))).first()[0]
    assert charged == (740 + len(rows)) * rtree.BYTES
    assert [rtree.depth_of(n, 4) for n in (0, 1, 4, 5, 16, 17)] == [1, 1, 1, 2, 2, 3]


def test_same_rows_few_pages(spark, features, tmp_path):
    path = str(tmp_path / "t")
    rtree.write_rtree(features, path, 4, ["id"])
    boxes = [(0, -10.0, -10.0, 10.0, 10.0), (1, 1.5, 1.5, 1.5, 1.5), (2, 900.0, 0.0, 901.0, 1.0), (3, -60.0, -90.0, 60.0, 90.0)]
    got = rtree.overlapping(spark, path, boxes, 4)
    rows = lambda df: sorted(map(tuple, df.select("query", *features.columns).collect()))
    assert rows(got) == rows(spatial.overlapping(features, boxes))
    assert got.columns == ["query", *features.columns]
    assert rtree.overlapping(spark, path, [], 4).count() == 0 and rtree.overlapping(spark, path, boxes[2:3], 4).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = rtree.overlapping(spark, path, boxes[1:2], 4)
        assert len(one.collect()) == len(rows(one)) >= 40
        leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
        read = [leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if "/features" in leaves.apply(k).toString()]
        assert 0 < read[0] < len(spark.read.parquet(f"{path}/features").inputFiles()) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_edges(spark, features, tmp_path):
    rtree.write_rtree(features.limit(1), str(tmp_path / "one"), 4)
    assert rtree.overlapping(spark, str(tmp_path / "one"), [(0, -1e9, -1e9, 1e9, 1e9)], 4).count() == 1
    with pytest.raises(ValueError, match="rtree_leaf"):
        rtree.write_rtree(features.withColumnRenamed("place", "RTREE_LEAF"), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no feature"):
        rtree.write_rtree(features.where("id = 2000"), str(tmp_path / "y"))
