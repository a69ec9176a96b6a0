"""Product runs by plain Python, their scope and report; concurrent workers, failures, block-aligned windows, stacks."""

import json
import random
import statistics
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, measure, mosaic, product_run, protocol, raster, report
from quarry.sources.options import read


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(1)
    objects = [(f"p{k % 3}", rng.randint(0, 5000)) for k in range(60)] + [("q0", 7), (None, 9)]
    writes = [(f"p{k % 2}", rng.random(), float(rng.randint(1, 99)), float(k) if k % 3 else None) for k in range(20)]
    measured = [(f"p{p}", "read", c, n, r, w, comp, "seconds", rng.random(), None) for p in range(3) for c, n in (("cold", 1), ("warm", 2)) for r in range(2) for w in range(n) for comp in range(2)]
    measured += [("p0", "display", "warm", 1, 0, 0, 0, "display_condition_skipped", None, "no tiles"), ("p1", "read", "cold", 1, 0, 0, 0, "seconds", None, "gone")]
    return (
        spark.createDataFrame(objects, "product string, size long"),
        spark.createDataFrame(writes, "product string, elapsed double, bytes_out double, bytes_in double"),
        spark.createDataFrame(measured, "product string, phase string, cache string, concurrency int, replicate int, worker int, component int, metric string, value double, error string"),
    )


def test_records(spark, inputs):
    got = {r.product if not r.is_rollup else "*": r for r in product_run.product_run(*inputs, product_run.Plan(prefix="p")).records.collect()}
    assert set(got) == {"p0", "p1", "p2", "*"}
    rows = [df.collect() for df in inputs]
    for name, r in got.items():
        of = lambda k: [x for x in rows[k] if (x.product or "").startswith("p") and name in ("*", x.product)]  # noqa: B023, E731
        sizes = [x["size"] for x in of(0)]
        assert (r.object_count, r.total_bytes, r.products) == (len(sizes), sum(sizes), 3 if name == "*" else 1)
        assert r.median_bytes == statistics.median(sizes)
        w = of(1)
        assert (r.write is None) == (not w)
        if w:
            assert (r.write.components, r.write.bytes_out) == (len(w), sum(x.bytes_out for x in w))
            assert r.write.throughput == pytest.approx(sum(x.bytes_out for x in w) / sum(x.elapsed for x in w))
        for c in (x for x in r.conditions if x.metric == "seconds"):
            workers = {}
            for x in of(2):
                if (x.phase, x.cache, x.concurrency, x.metric) == (c.phase, c.cache, c.concurrency, c.metric) and x.error is None:
                    workers.setdefault((x.product, x.component, x.replicate), []).append(x.value)
            values = [statistics.mean(v) for v in workers.values()]
            assert c.replicates == len(values) and c.error is None
            assert (c.mean, c.median, c.spread) == pytest.approx((statistics.mean(values), statistics.median(values), statistics.pstdev(values)))
    skipped = [c for c in got["*"].conditions if c.replicates == 0]
    assert [(c.phase, c.error, c.mean) for c in skipped] == [("display", "no tiles", None)] and not [c for c in got["p2"].conditions if c.error]


def test_scope(spark, inputs):
    names = lambda **o: sorted(r.product for r in product_run.product_run(*inputs, product_run.Plan(**o)).records.where("not is_rollup").collect())
    assert names() == ["p0", "p1", "p2", "q0"] and names(scope="product") == ["p0"] and names(scope="product", limit=2) == ["p0", "p1"] and names(pattern="[12]$") == ["p1", "p2"]
    for bad in ({"prefix": "x"}, {"limit": 0}, {"pattern": "^z"}):
        with pytest.raises(ValueError, match="no products"):
            names(**bad)
    with pytest.raises(ValueError, match="scope"):
        product_run.Plan(scope="all")
    few = product_run.product_run(*inputs, product_run.Plan(samples=1, metrics=["seconds"])).records.where("is_rollup").first()
    assert {c.metric for c in few.conditions} == {"seconds"} and [c.replicates for c in few.conditions] == [6, 6]


def test_written(spark, inputs, tmp_path):
    path = str(tmp_path / "r")
    run = product_run.write_run(product_run.product_run(*inputs), path)
    assert run.observed["products"] == 4 and run.observed["objects"] == 61
    assert sorted(p.name for p in Path(path, "records").glob("run=*")) == ["run=product-p0", "run=product-p1", "run=product-p2", "run=product-q0", "run=rollup"]
    one = json.loads(next(Path(path, "records/run=product-q0").glob("*.json")).read_text())
    assert one["object_count"] == 1 and one["conditions"] == []
    lines = [x for f in sorted(Path(path, "summary").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0] == "## Products" and lines[4].startswith("| p0 | 20 |") and lines[8].startswith("| **all products** | 61 |") and "## Conditions over all products" in lines and lines[-1].endswith("| no tiles |")
    assert product_run.size_line(run).startswith("4 products, 61 objects, ")


def test_workers_overlap(spark):
    """Both workers wait for each other, so one alone would never end; each runs a job of its own at that time."""
    barrier, seen = threading.Barrier(2, timeout=60), []

    def action(seed):
        barrier.wait()
        began = time.perf_counter()
        spark.range(2).repartition(2).rdd.map(lambda x: time.sleep(0.5) or x).count()
        seen.append((seed, began, time.perf_counter()))
        barrier.wait()

    got = protocol.measure(spark, action, "read", 2, [protocol.Condition("cold", 2)], 10).collect()
    assert [(r.replicate, r.worker, r.error) for r in got] == [(0, 0, None), (0, 1, None), (1, 0, None), (1, 1, None)]
    spans = {s: (a, b) for s, a, b in seen}
    assert set(spans) == {10, 11, 12, 13}
    for a, b in ((10, 11), (12, 13)):
        assert max(spans[a][0], spans[b][0]) < min(spans[a][1], spans[b][1])


def test_failure_cancels_the_others(spark):
    ended, long = [], [20]

    def action(seed):
        if seed % 2:
            time.sleep(1)
            raise OSError("disk gone")
        try:
            seconds = long[0]
            spark.range(2).repartition(2).rdd.map(lambda x: time.sleep(seconds) or x).count()
        finally:
            ended.append(seed)

    began = time.perf_counter()
    with pytest.raises(OSError, match="disk gone"):
        protocol.together(spark, action, [4, 5], "tag-a")
    # The other worker's job was cancelled, and it has come to its end.
    assert time.perf_counter() - began < 15 and ended == [4]
    long[0] = 0
    got = protocol.measure(spark, action, "read", 1, [protocol.Condition("cold", 2), protocol.Condition("cold", 1)], 4).collect()
    # A row with its reason, and the other condition isn't touched.
    assert [(r.concurrency, r.metric, r.error) for r in got] == [(2, "read_condition_skipped", "disk gone"), (1, "read_seconds", None)]
    assert spark.range(10).count() == 10


def test_run_conditions(spark):
    done = []
    got = protocol.run_conditions(spark, {"a": lambda s: done.append(s), "b": lambda s: done.append(s)}, "display", {"replicates": 2, "conditions": [{"cache": "cold", "concurrency": 3}]}).collect()
    assert sorted({(r.component, r.cache, r.concurrency, r.replicate) for r in got}) == [("a", "warm", 1, 0), ("a", "warm", 1, 1), ("b", "warm", 1, 0), ("b", "warm", 1, 1)]
    assert protocol.run_conditions(spark, {}, "read", None).count() == 0


def test_block_aligned_windows():
    """By the rule: drawn column first, even ones snapped down to a block, odd ones moved by half a block off it, none beyond the edge."""
    for rows, cols, side, block in ((1000, 800, 64, (256, 128)), (300, 40, 64, (16, 512)), (64, 64, 64, (8, 8)), (500, 500, 10, (1, 0))):
        rng, want = random.Random(5), []
        for k in range(40):
            x, y = rng.randint(0, max(0, cols - side)), rng.randint(0, max(0, rows - side))
            at = []
            for v, last, step in ((x, max(0, cols - side), block[1]), (y, max(0, rows - side), block[0])):
                if k % 2 == 0 and step > 0:
                    v = min(v // step * step, last)
                elif k % 2 and step > 1 and v % step == 0:
                    v = min(v + step // 2, last)
                at.append(v)
            want.append((k, at[1], at[0], min(side, rows), min(side, cols)))
        got = protocol.random_windows(rows, cols, side, 40, 5, block)
        assert got == want
        assert all(r % block[0] == 0 for k, r, *_ in got if k % 2 == 0)
    assert protocol.random_windows(100, 100, 10, 9, 3) == protocol.random_windows(100, 100, 10, 9, 3, (0, 0))


def test_stack_bands(spark):
    rows = [("b", 2, 0.0, 0.0, 9.0, 9.0, 3, 3), ("a", 1, 0.0, 0.0, 9.0, 9.0, 3, 3), ("c", 3, 0.0, 0.0, 9.0, 9.0, 3, 3)]
    df = spark.createDataFrame(rows, "name string, place int, xmin double, ymin double, xmax double, ymax double, rows int, cols int")
    assert sorted(map(tuple, mosaic.stack_bands(df, "name", "place", wanted=["c", "a", "b"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError, match="one extent"):
        mosaic.stack_bands(df.withColumn("xmax", F.expr("if(name = 'c', 8.0, xmax)")), "name", "place")
    with pytest.raises(ValueError, match="one member"):
        mosaic.stack_bands(df.limit(0), "name", "place")
    for wanted in (["a", "b"], ["a", "b", "x"]):
        with pytest.raises(ValueError, match="are named"):
            mosaic.stack_bands(df, "name", "place", wanted=wanted)


def test_small_pieces(spark, tmp_path):
    one = read("single-object", spark.createDataFrame([], "uri string"), {"uri": "s3://b/x/scene.tif"}).collect()
    assert [(r.product, r.component, r.uri) for r in one] == [("scene", "scene", "s3://b/x/scene.tif")]
    reads = spark.createDataFrame([("a", 0.5, 10, 3), ("a", 1.5, 30, 5), ("b", 0.0, 8, 1)], "k string, s double, n long, f int")
    got = {r.k: r for r in measure.latency_summary(reads, ["k"], "s", "n", "f").collect()}
    assert (got["a"].f, got["a"].throughput, got["b"].throughput) == (8, 20.0, float("inf"))
    assert {r.k: r.throughput for r in measure.latency_summary(reads, ["k"], "s", "n", "f", 24).collect()}["a"] == 8 * 24 / 2
    assert catalog.viewer_bands(["wse"]) == ["wse"] and catalog.viewer_bands(["all"], ["a", "b"]) == ["a", "b"]
    params = spark.createDataFrame([(5, 7)], "nodata int, other int")
    assert params.select(catalog.merged({"nodata": 1}, "nodata", "nodata").alias("v")).first().v == 1 and params.select(catalog.merged({}, "nodata", "nodata").alias("v")).first().v == 5
    cells = spark.createDataFrame([(lv, r, c, float(r + c)) for lv, n in ((0, 5), (1, 2)) for r in range(n) for c in range(n)], "level int, row long, col long, value double")
    raster.write_store(cells, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("level=*")) == ["level=0", "level=1"]
    assert sorted(map(tuple, back.select("level", "row", "col", "value").collect())) == sorted(map(tuple, cells.collect()))
    report.write_report(spark.createDataFrame([(1, "b"), (0, "a")], "line_no int, line string"), reads, str(tmp_path / "w"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "w/summary").glob("part*"))) == "a\nb\n"
    assert spark.read.json(str(tmp_path / "w/result")).count() == 3
