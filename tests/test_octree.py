"""Written octrees: every point once with its columns, nodes and folders chosen before points are read."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import points


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(2)
    rows = [(k % 400, rng.gauss(0, 1), rng.gauss(0, 1) ** 3, rng.random(), f"n{k % 7}", k, k) for k in range(900)]
    rows += [(1, 0.5, 0.5, 0.5, "same", -1, 0)] * 3 + [(2, float("nan"), 0.0, 0.0, "lost", 0, 0), (3, None, 0.0, 0.0, "lost", 0, 0)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, node string, row long, octree_row int")


def test_every_point_once(spark, cloud, tmp_path):
    path = str(tmp_path / "o")
    points.write_octree(cloud, path, span=2)
    back = spark.read.parquet(f"{path}/points")
    assert set(back.columns) == {*cloud.columns, "octree_part", "octree_node"}
    rows = lambda df: sorted(map(tuple, df.select(*cloud.columns).collect()))
    assert rows(back) == rows(points.finite(cloud)) and len(rows(back)) == 903
    nodes = spark.read.parquet(f"{path}/nodes")
    assert nodes.agg(F.sum("points")).first()[0] == 903
    assert sorted(r.points for r in nodes.collect()) == sorted(r["count"] for r in back.groupBy("octree_node").count().collect())
    # Three rows of one pid stay three, as in the table of nodes by point.
    assert back.where("node = 'same'").count() == 3
    with pytest.raises(ValueError, match="octree_node"):
        points.write_octree(cloud.withColumnRenamed("node", "octree_node"), path)
    with pytest.raises(ValueError, match="no points"):
        points.write_octree(cloud.limit(0), path)


def test_boxes_read_few_folders(spark, cloud, tmp_path):
    path = str(tmp_path / "o")
    points.write_octree(cloud, path, span=2)
    boxes = [(0, -3.0, -30.0, 0.0, -1.0, 0.0, 0.4), (1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (2, 50.0, 0.0, 0.0, 60.0, 1.0, 1.0)]
    got = points.octree_boxes(spark, path, boxes)
    rows = lambda df: sorted(map(tuple, df.select("query", *cloud.columns).collect()))
    assert rows(got) == rows(points.in_cube(points.finite(cloud), boxes)) and len(rows(got)) > 5
    assert points.octree_boxes(spark, path, []).count() == 0 and points.octree_boxes(spark, path, boxes[2:]).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = points.octree_boxes(spark, path, boxes[1:2])
        assert one.count() == 3
        plan = one._jdf.queryExecution().executedPlan()
        assert "octree_part" in plan.toString().split("PartitionFilters: [")[1].split("]")[0]
        one.collect()
        leaves = plan.collectLeaves()
        read = [leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if "octree_part" in leaves.apply(k).toString().split("PartitionFilters: [")[-1].split("]")[0]]
        assert 0 < read[0] < len(spark.read.parquet(f"{path}/points").inputFiles()) / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boxes_reach_the_scan(spark, cloud, tmp_path):
    cloud.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for asked in (points.in_cube(df, [(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]), points.in_box(df, [(0, 0.0, 0.0, 1.0, 1.0), (1, 2.0, 2.0, 3.0, 3.0)])):
        pushed = asked._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(x,0.0), LessThanOrEqual(x," in pushed
    assert points.in_box(df, []).count() == 0


def test_tasks_finish_small_nodes(spark, cloud):
    """Wherever one task takes over, every point is where the level-by-level split over all tasks has it."""
    from quarry.plans.tables import written

    rows = lambda **o: sorted(map(tuple, points.octree(cloud, checkpoint=written, **o).collect()))
    for span, depth in ((1, 21), (2, 3), (3, 21)):
        want = rows(span=span, most_depth=depth, local=0)
        assert len(want) == 903
        for local in (30, 300, 10_000):
            assert rows(span=span, most_depth=depth, local=local) == want
