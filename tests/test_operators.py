"""Operators against brute force and golden values; traps of the semantics; edge cases."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import grid, uri
from quarry.operators import catalog, measure, points, profile, raster, report, spatial, tiles
from quarry.sources import listing
from quarry.sources.registry import Registry


def sizes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "size long")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_profile_golden(spark):
    r = profile.size_profile(sizes(spark, [10, 20, 30, 40])).first()
    assert (r.object_count, r.total_bytes, r.mean_bytes, r.median_bytes, r.min_bytes, r.max_bytes) == (4, 100, 25.0, 25.0, 10, 40)
    assert r.p90_bytes == pytest.approx(37.0) and r.p95_bytes == pytest.approx(38.5) and r.p99_bytes == pytest.approx(39.7)
    with pytest.raises(Exception, match="object size"):
        profile.size_profile(profile.validated(sizes(spark, [1, -1]))).collect()


def test_rollup_pools_objects(spark):
    df = spark.createDataFrame([("a", 1)] * 9 + [("b", 100)], "product string, size long")
    got = {r.product: r.median_bytes for r in profile.size_profile(df, ["product"], rollup=True).collect()}
    assert got == {"a": 1, "b": 100, None: 1}


def test_histogram_and_tiers(spark):
    got = [(r.bin, r.low, r.high, r.n) for r in profile.histogram(sizes(spark, [0, 1, 9, 8])).orderBy("bin").collect()]
    assert got == [(0, 1, 2, 2), (1, 2, 4, 0), (2, 4, 8, 0), (3, 8, 16, 2)]
    assert [r.n for r in profile.histogram(sizes(spark, [1, 5, 99]), [2, 4, 6]).orderBy("bin").collect()] == [1, 2]
    for bad in ([1], [2, 2], [3, 1]):
        with pytest.raises(ValueError):
            profile.histogram(sizes(spark, [1]), bad)
    fits = lambda m: one(spark, profile.tiers_fit(F.lit(m)).alias("t"), profile.highest_tier(F.lit(m)).alias("h"))
    assert fits(float((32 << 20) - 1))[:] == ([], None)
    assert fits((32 << 20) - 0.5).t == [] and fits(float(32 << 20)).t == ["warm"]
    assert fits(float(200 << 20))[:] == (["warm", "cold"], "cold")


def test_throughput_is_infinite_without_time(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0, None)], "k string, elapsed double, bytes_out double, bytes_in double")
    r = measure.write_rollup(df, ["k"]).first()
    assert r.throughput == float("inf") and r.bytes_in is None


def test_hilbert_is_a_curve(spark):
    d = {(r.x, r.y): r.d for r in spark.range(256).select((F.col("id") % 16).alias("x"), F.expr("id div 16").alias("y")).select("x", "y", grid.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(d.values()) == list(range(256))
    at = {v: k for k, v in d.items()}
    assert all(abs(at[k][0] - at[k + 1][0]) + abs(at[k][1] - at[k + 1][1]) == 1 for k in range(255))


def test_octree_against_recursion(spark):
    rng = random.Random(2)
    cloud = [(k, rng.random() ** 3, rng.random() ** 3, rng.random()) for k in range(700)] + [(9000 + k, 0.5, 0.5, 0.5) for k in range(30)]
    df = spark.createDataFrame([*cloud, (99999, float("nan"), 0.0, 0.0), (99998, float("inf"), 0.0, 0.0)], "pid long, x double, y double, z double")
    span, cap = 2, 5
    low = [min(p[k] for p in cloud) for k in (1, 2, 3)]
    side = max(max(p[k] for p in cloud) - low[k - 1] for k in (1, 2, 3))
    want = {}

    def go(pts, depth, n, s):
        name = f"{depth}-{n[0]}-{n[1]}-{n[2]}"
        if len(pts) <= span**3 or depth == cap:
            want.update({p[0]: name for p in pts})
            return
        first = {}
        for p in sorted(pts):
            cell = tuple(min(int((p[k + 1] - (low[k] + n[k] * s)) // (s / span)), span - 1) for k in range(3))
            first.setdefault(cell, p)
        kept = {p[0] for p in first.values()}
        want.update({k: name for k in kept})
        octants = {}
        for p in pts:
            if p[0] not in kept:
                octants.setdefault(tuple(2 * n[k] + (p[k + 1] >= low[k] + n[k] * s + s / 2) for k in range(3)), []).append(p)
        for o, rest in octants.items():
            go(rest, depth + 1, o, s / 2)

    go(cloud, 0, (0, 0, 0), side)
    from quarry.plans.tables import written

    got = points.octree(df, span, cap, checkpoint=written)
    assert {r.pid: r.node for r in got.collect()} == want
    layout = points.node_layout(got).collect()
    assert sum(r.points for r in layout) == len(cloud) and all(r.max_node_points <= 8 for r in layout if r.depth < cap)


def test_pyramid_truncates_level_by_level(spark):
    cells = spark.createDataFrame([(r, c, float(v)) for r, row in enumerate([[-1, -2, 9], [-2, -2, 9], [1, 1, 9]]) for c, v in enumerate(row)], "row long, col long, value double")
    got = {(r.level, r.row, r.col): r.value for r in raster.pyramid(cells, 3, 3, [2, 2], integer=True).where("level > 0").collect()}
    assert got == {(1, 0, 0): -1.0}
    fill = raster.block_mean(cells, 3, 3, 3, fill=9.0).first().value
    assert fill == pytest.approx((-1 - 2 - 2 - 2 + 1 + 1) / 6)


def test_mosaic_stack_windows_blocks(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0), (2, 0, 0, -9.0), (0, 0, 1, 5.0)], "ordinal int, row long, col long, value double")
    assert {(r.row, r.col): r.value for r in raster.mosaic(cells, -9.0).collect()} == {(0, 0): 2.0, (0, 1): 5.0}
    stacked = raster.stack(cells.withColumnRenamed("ordinal", "band"), [0, 1]).orderBy("col").collect()
    assert [(r["0"], r["1"]) for r in stacked] == [(1.0, 2.0), (5.0, None)]
    assert {(r.window, r.value) for r in raster.window_reads(cells, [(7, 0, 1, 1, 1)]).collect()} == {(7, 5.0)}
    assert raster.window_reads(cells, []).count() == 0
    assert raster.blocks(cells.where("ordinal = 0"), 1, 2, 2).first()["values"] == [1.0, 5.0]
    assert one(spark, raster.offset_in_mosaic(F.lit(2.5), F.lit(0.0), F.lit(1.0)).alias("o")).o == 2


def test_spatial_policies(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 5.0, 5.0), (2, None, None, None, None, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double, lon double, lat double")
    assert [r.id for r in spatial.drop_null(df).collect()] == [1]
    s = spatial.sentinel(df.withColumn("null_geometry", F.lit(0))).where("id = 2").first()
    assert (s.xmin, s.ymin, s.null_geometry_) == (-1.1, -1.1, True)
    with pytest.raises(ValueError):
        spatial.drop_null(df.where("id = 2"))
    with pytest.raises(ValueError):
        spatial.point_from(df, "lon", "nowhere")
    with pytest.raises(Exception, match="lat is null"):
        spatial.point_from(df.withColumn("lat", F.lit(None).cast("double")), "lon", "lat").collect()
    assert [(r.query, r.id) for r in spatial.overlapping(df, [(1, 10.0, 10.0, 11.0, 11.0), (2, 10.1, 0.0, 11.0, 1.0)]).collect()] == [(1, 1)]


def test_clustered_files_are_pruned(spark, tmp_path):
    df = spark.range(2000).select("id", *[((F.col("id") * k) % 100).cast("double").alias(c) for k, c in ((7, "xmin"), (13, "ymin"), (7, "xmax"), (13, "ymax"))])
    spatial.write_clustered(df, f"{tmp_path}/f", partitions=2, row_group_rows=500)
    back = spark.read.parquet(f"{tmp_path}/f")
    near = spatial.overlapping(back, [(0, 1.0, 1.0, 3.0, 3.0)])
    assert near.count() == df.where("xmin between 1 and 3 and ymin between 1 and 3").count()
    assert "PushedFilters: [IsNotNull" in near._jdf.queryExecution().explainString(near.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    layout = listing.parquet_layout(spark, f"{tmp_path}/f").collect()
    assert sum(r.rows for r in layout) == 2000 and {r.codec for r in layout} == {"zstd"} and max(r.max_group_rows for r in layout) <= 500


def test_grid_functions(spark):
    gt = F.array(*[F.lit(x) for x in (10.0, 2.0, 0.0, 50.0, 0.0, -3.0)])
    r = one(spark, grid.bounds(gt, F.lit(4), F.lit(5)).alias("b"), grid.pixel_size(gt).alias("p"), grid.affine_order(gt).alias("a"), grid.decimate(gt, F.lit(2)).alias("d"), grid.parse_geotransform(F.lit("1 2 3 4 5 x")).alias("bad"), grid.parse_geotransform(F.lit("1 2 3 4 5 6")).alias("ok"))
    assert tuple(r.b) == (10.0, 38.0, 20.0, 50.0) and r.p == 2.0 and r.a == [2.0, 0.0, 10.0, 0.0, -3.0, 50.0] and r.d == [10.0, 4.0, 0.0, 50.0, 0.0, -6.0]
    assert r.bad is None and r.ok == [1, 2, 3, 4, 5, 6]
    depth = lambda h, w: one(spark, grid.auto_depth(F.lit(h), F.lit(w)).alias("d")).d
    assert [depth(255, 999), depth(256, 999), depth(511, 511), depth(512, 512), depth(4096, 2048)] == [0, 0, 0, 1, 3]
    s = one(spark, grid.fit_shard(F.lit(1000), F.lit(256), F.lit(700)).alias("f"), grid.fit_shard(F.lit(1), F.lit(256), F.lit(700)).alias("g"), grid.auto_shard(F.lit(700), F.lit(256)).alias("a"), grid.fit_chunk(F.lit(0), F.lit(9)).alias("c"))
    assert (s.f, s.g, s.a, s.c) == (512, 256, 768, 1)
    b = one(spark, *[grid.blocks_spanned(F.lit(x), F.lit(y), F.lit(512)).alias(f"b{k}") for k, (x, y) in enumerate([(0.0, 512.0), (0.0, 513.0), (511.0, 513.0), (5.0, 5.0)])])
    assert tuple(b) == (1, 2, 2, 1)
    n = one(spark, *[grid.index_bytes(F.lit(k), F.lit(16)).alias(f"n{k}") for k in (0, 16, 17)])
    assert tuple(n) == (0, 17 * 40, 20 * 40)
    m = one(spark, grid.longitude(grid.mercator_x(F.lit(12.5))).alias("x"), grid.latitude(grid.mercator_y(F.lit(48.25))).alias("y"))
    assert (m.x, m.y) == (pytest.approx(12.5), pytest.approx(48.25))


def test_uri_functions(spark):
    wkt = 'PROJCRS["x",ID["EPSG",1],ID["EPSG",32631]]'
    r = one(spark, uri.netcdf_container(F.lit('NETCDF:"/a/b.nc":wse')).alias("n"), uri.zip_container(F.lit("/vsizip//d/a.zip/m.tif")).alias("z"), uri.zip_container(F.lit("/d/a.tif")).alias("no"), uri.epsg_of(F.lit(wkt)).alias("e"), uri.date_of(F.lit("x_20150706_y")).alias("d"), uri.bucket(F.lit("s3://b/k/x")).alias("b"), uri.extension(F.lit("s3://b/k.FGB?x=1.y")).alias("x"), uri.join_uri(F.lit("s3://b/"), F.lit("k")).alias("j"), uri.stem_without(F.lit("/a/b.zip"), ".zip").alias("s"))
    assert (r.n, r.z, r.no, r.e, str(r.d), r.b, r.x, r.j, r.s) == ("/a/b.nc", "/d/a.zip", None, 32631, "2015-07-06", "b", ".fgb", "s3://b/k", "b")
    assert one(spark, uri.bucket(F.lit("/a/b")).alias("b"), uri.key(F.lit("/a/b")).alias("k")) == (None, None)
    for f in (uri.bucket, uri.key):
        with pytest.raises(Exception, match="no bucket"):
            one(spark, f(F.lit("s3:///k")).alias("b"))
    f = one(spark, *[uri.format_bytes(F.lit(n)).alias(f"f{k}") for k, n in enumerate((0, 1023, 1536, 9472, 5 << 20, 3 << 50, 5000 << 50))])
    assert tuple(f) == ("0 B", "1023 B", "1.5 KiB", "9.2 KiB", "5.0 MiB", "3.0 PiB", "5000.0 PiB")


def test_listing_sources(spark, tmp_path):
    for k in ("a/b/1.tif", "a/b/2.txt", "a/bc/3.tif", "4.tif"):
        (tmp_path / "t" / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / k).write_bytes(b"x" * (len(k)))
    rows = listing.list_objects(spark, f"{tmp_path}/t")
    keys = lambda **o: [r.key for r in listing.select_objects(rows, **o).collect()]
    assert keys() == ["4.tif", "a/b/1.tif", "a/b/2.txt", "a/bc/3.tif"]
    assert keys(prefix="a/b") == ["a/b/1.tif", "a/b/2.txt"] and keys(suffix=".tif", pattern="b", limit=1) == ["a/b/1.tif"] and keys(limit=0) == []
    assert keys(prefix="a/b", whole_parts=False) == ["a/b/1.tif", "a/b/2.txt", "a/bc/3.tif"]
    again = tmp_path / "t" / str(tmp_path / "t")[1:] / "in"
    again.mkdir(parents=True)
    (again / "x y.txt").write_bytes(b"abc")
    assert f"{str(tmp_path / 't')[1:]}/in/x y.txt" in {r.key for r in listing.list_objects(spark, f"{tmp_path}/t").collect()}
    assert [r.key for r in listing.list_objects(spark, f"{tmp_path}/t", str(again)[len(str(tmp_path / 't')) + 1 :]).collect()] == [f"{str(tmp_path / 't')[1:]}/in/x y.txt"]
    assert listing.object_size(spark, f"{again}/x y.txt") == 3 and listing.object_size(spark, f"{again}/none") is None and listing.object_size(spark, f"{tmp_path}/no/folder") is None
    with pytest.raises(Exception, match="no such path"):
        listing.list_objects(spark, f"{tmp_path}/nowhere").collect()
    (tmp_path / "l.json").write_text('[5, {"name": "n", "size": 7}]')
    assert [tuple(r) for r in listing.json_listing(spark, f"{tmp_path}/l.json").collect()] == [("#0", 5), ("n", 7)]
    (tmp_path / "bad.json").write_text('[5, {"name": "n"}]')
    with pytest.raises(Exception, match="entry 1"):
        listing.json_listing(spark, f"{tmp_path}/bad.json").collect()
    with zipfile.ZipFile(tmp_path / "S1.zip", "w") as z:
        for m in ("d/S_FRE_B2.tif", "d/S_FRE_B5.tif", "d/S_FRE_B8.tif", "d/S_QKL.jpg", "d/MASKS/S_CLM_R1.tif", "d/s_vv_GAM_x.tif", "d/s_VH_GAM_y.tif", "d/l.shp", "d/l.shp.xml"):
            z.writestr(m, "x")
    members = listing.zip_members(spark, f"{tmp_path}/S1.zip")
    assert [r.component for r in catalog.archive_bands(members, ["B5", "B2", "B8"], ["CLM"]).collect()] == ["B2", "B8", "B5", "CLM_R1"]
    assert [r.component for r in catalog.radar_polarisations(members, ["VH", "VV"]).collect()] == ["VH", "VV"]
    assert [r.component for r in catalog.shape_archives(members).collect()] == ["l"]
    nc = spark.createDataFrame([("/g/A.nc",)], "uri string")
    assert [r.address for r in catalog.granule_variables(nc, ["wse", "area"]).collect()] == ['NETCDF:"/g/A.nc":wse', 'NETCDF:"/g/A.nc":area']
    whole = spark.createDataFrame([("/g/A.nc", ["b", "a"]), ("/g/B.nc", ["c"])], "uri string, found array<string>")
    assert [(r.product, r.component) for r in catalog.granule_variables(whole, ["all"]).collect()] == [("A", "b"), ("A", "a"), ("B", "c")]
    with pytest.raises(ValueError, match="found"):
        catalog.granule_variables(nc, ["*"])
    assert [r.component for r in catalog.granule_variables(nc, []).collect()] == ["wse"]
    assert listing.gradient(spark, 4).where("band = 1 and col = 3").first().value == 255.0


def test_bundles_and_registry(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "product string, component string")
    got = lambda g: sorted(((r.product, r.component, r.bundle) for r in catalog.bundles(df, g).collect()), key=str)
    assert got(None) == [("p", "a", None), ("p", "b", None), ("q", "a", None)]
    assert got(True) == [("p", "a", "all"), ("p", "b", "all"), ("q", "a", None)]
    assert [x for x in got({"g": ["a", "b"], "h": ["b", "a"], "one": ["a"]}) if x[0] == "q"] == [("q", "a", "g"), ("q", "a", "h")]
    with pytest.raises(ValueError, match="nowhere"):
        catalog.bundles(df, {"g": ["nowhere"]})
    r = Registry("thing")
    r.register("x", 1)
    with pytest.raises(ValueError):
        r.register("x", 2)
    with pytest.raises(KeyError, match="there are x"):
        r.get("y")


def test_octree_keeps_points_of_one_pid(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0), (3, 0.1, 0.1, 0.1)]
    from quarry.plans.tables import written

    got = points.octree(spark.createDataFrame(rows, "pid long, x double, y double, z double"), span=1, checkpoint=written)
    assert sorted(r.pid for r in got.collect()) == [1, 1, 2, 3]


def test_null_policy(spark):
    schema = "id int, lon double, lat double, xmin double, ymin double, xmax double, ymax double"
    whole = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], schema)
    some = whole.unionByName(spark.createDataFrame([(2, 5.0, 6.0, None, None, None, None)], schema))
    assert spatial.with_null_policy(whole).count() == 1
    with pytest.raises(ValueError, match="1 features"):
        spatial.with_null_policy(some)
    assert [r.id for r in spatial.with_null_policy(some, "drop").collect()] == [1]
    assert {r.id: (r.xmin, r.null_geometry) for r in spatial.with_null_policy(some, "point_from", "lon", "lat").collect()} == {1: (0.0, False), 2: (5.0, True)}
    assert {r.id: r.xmin for r in spatial.with_null_policy(some, "sentinel").collect()}[2] < 0
    for bad in ("point_from", "other"):
        with pytest.raises(ValueError):
            spatial.with_null_policy(some, bad)


def test_free_name(spark):
    from quarry.functions.names import free_name

    df = spark.createDataFrame([(1, 2)], "Flag int, flag_ int")
    assert free_name(df, "flag") == "flag__" and free_name(df, "other") == "other"


def test_report(spark):
    df = spark.createDataFrame([("a", 2048)], "product string, size long")
    rows = report.product_rows(profile.size_profile(df, ["product"], rollup=True))
    lines = [r.line for r in report.markdown(rows, "T", ["product", "objects", "total", "mean", "p95"]).orderBy("line_no").collect()]
    assert lines[0] == "## T" and lines[4] == "| a | 1 | 2.0 KiB | 2.0 KiB | 2.0 KiB |" and lines[5].startswith("| **all products** | 1 |")


def test_streaming_profile(spark, tmp_path):
    from quarry.streaming import profile as streaming

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bin").write_bytes(b"x" * (k + 1))
    out = []
    stream = streaming.windowed_profile(streaming.arriving_objects(spark, f"{tmp_path}/in"))
    streaming.run_available(stream, f"{tmp_path}/c", lambda df, _: out.extend(df.collect()), "update").awaitTermination()
    assert (sum(r.object_count for r in out), sum(r.total_bytes for r in out)) == (3, 6)


def test_stack_tasks_grow_with_rows(spark, monkeypatch):
    from quarry.plans import products

    monkeypatch.setattr(raster, "TASK_ROWS", 1000, raising=False)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    out = products.stack_growing(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One exchange, and one grouping (two halves) for the cells and one for all bands.
    assert plan.count("Exchange hashpartitioning") == 1 and "pivotfirst" not in plan and plan.count("HashAggregate(") == 4
    assert out.rdd.getNumPartitions() == -(-rows // 1000)
