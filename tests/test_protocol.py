"""Protocol by resolution, layout and artifact lines."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import protocol, report


def test_protocol(spark):
    assert protocol.parse_protocol(None) == (1, [protocol.Condition()])
    n, conditions = protocol.parse_protocol({"replicates": 2, "conditions": [{"cache": "cold"}, {"concurrency": 2}]})
    for bad in ({"replicates": 0}, {"conditions": [{"cache": "tepid"}]}, {"conditions": [{"concurrency": 0}]}):
        with pytest.raises(ValueError):
            protocol.parse_protocol(bad)
    seeds = []
    got = protocol.measure(spark, seeds.append, "read", n, conditions, seed=100).collect()
    assert [(r.cache, r.replicate, r.worker) for r in got] == [("cold", 0, 0), ("cold", 1, 0), ("warm", 0, 0), ("warm", 0, 1), ("warm", 1, 0), ("warm", 1, 1)]
    assert seeds[:2] == [100, 101] and sorted(seeds[2:]) == [98, 99, 100, 101, 102, 103]

    def fails(_):
        raise OSError("gone")

    r = protocol.measure(spark, fails, "read", 1, [protocol.Condition()]).first()
    assert (r.metric, r.value, r.error) == ("read_condition_skipped", None, "gone")
    assert protocol.capabilities(spark).where("capability = 'spark'").first().present


def test_random_places_stay_inside():
    for _, r, c, h, w in protocol.random_windows(100, 50, 64, 20, 3):
        assert 0 <= r <= 100 - h and c == 0 and (h, w) == (64, 50)
    for _, x0, y0, x1, y1 in protocol.random_boxes((0.0, 0.0, 9.0, 9.0), 8, 1):
        assert 0 <= x0 and 0 <= y0 and x1 <= 9.0000001 and y1 <= 9.0000001 and x1 - x0 == pytest.approx(3)
    assert protocol.random_windows(9, 9, 2, 3, 1) == protocol.random_windows(9, 9, 2, 3, 1)


def test_layout_and_artifact_lines(spark):
    rows = [("a", "raster", 100, 1, True, None, 0), ("b", "store", 1000, 4, None, None, 250), ("c", "indexed", 0, 1, None, False, 0)]
    df = spark.createDataFrame(rows, "name string, kind string, size long, parts long, tiled boolean, indexed boolean, overview_bytes long")
    lines = {r.line for r in report.layout_rows(df).collect()}
    assert lines == {"| a | raster | 100 B | tiled |", "| b | store | 1000 B | 4 shards, overviews 25.0 % |", "| c | indexed | 0 B | without index |"}
    art = spark.createDataFrame([("figure", None, "no points"), ("map", "/x/m.json", None)], "name string, uri string, reason string")
    assert [r.line for r in report.artifact_rows(art).orderBy("place").collect()] == ["* figure: skipped (no points)", "* map: /x/m.json"]
    assert report.artifact_rows(art.withColumn("reason", F.lit(None).cast("string"))).count() == 2
