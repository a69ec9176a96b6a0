"""Ladders, mosaics, stores, options and runs, by small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.grid import cell_centres
from quarry.operators import ladders, mosaic, points, protocol, report, run, spatial, store
from quarry.operators.order import numbered
from quarry.sources import listing, options
from quarry.sources.registry import layouts, readers


def _ladder(spark, pixels, rows=512, cols=512, levels="auto"):
    grids = spark.createDataFrame([(f"c{p:g}", p, rows, cols) for p in pixels], "component string, pixel double, rows long, cols long")
    got = ladders.ladder(grids, levels).collect()
    return {f"c{p:g}": sorted((r.level, r.decimation, r.factor, r.native) for r in got if r.component == f"c{p:g}") for p in pixels}


def test_ladders(spark):
    decimations = lambda *a, **k: [x[1] for x in _ladder(spark, *a, **k)["c10"]]
    assert decimations([10.0], 1024, 4096) == [1, 2, 4] and decimations([10.0], 255, 255, levels=None) == [1] and decimations([10.0], 10, 10, levels=3) == [1, 2, 4, 8] and decimations([10.0], levels=-2) == [1]
    assert decimations([10.0], levels=[20, 60, 120, 360]) == [1, 2, 6, 12, 36] and [x[2] for x in _ladder(spark, [10.0], levels=[20, 60, 120])["c10"]] == [1, 2, 3, 2]
    assert decimations([10.0], 8, 20, levels=5) == [1, 2, 4, 8]  # no level without a cell
    for bad, what in (([25], "finest"), ([20, 20], "larger"), ([60, 20], "larger"), ([10], "larger"), ([20, 30], "level before")):
        with pytest.raises(ValueError, match=what):
            _ladder(spark, [10.0], levels=bad)
    assert _ladder(spark, [10.0, 20.0, 60.0]) == {"c10": [(0, 1, 1, True), (1, 2, 2, False), (2, 6, 3, False), (3, 12, 2, False)], "c20": [(1, 2, 1, True), (2, 6, 3, False), (3, 12, 2, False)], "c60": [(2, 6, 1, True), (3, 12, 2, False)]}
    assert _ladder(spark, [10.0, 60.0], levels=[20, 60, 120])["c60"] == [(2, 6, 1, True), (3, 12, 2, False)]
    for pixels, levels, what in (([10.0, 60.0], [20, 120], "not among"), ([10.0, 20.0, 30.0], 0, "level before"), ([10.0, 25.0], 0, "finest")):
        with pytest.raises(ValueError, match=what):
            _ladder(spark, pixels, levels=levels)


def test_ladders_of_several_bundles(spark):
    grids = spark.createDataFrame([("p", "a", 10.0, 90, 90), ("p", "b", 30.0, 30, 30), ("q", "a", 5.0, 40, 8), ("q", "b", 5.0, 8, 8)], "product string, component string, pixel double, rows long, cols long")
    got = sorted((r.product, r.component, r.level, r.factor, r.rows, r.cols) for r in ladders.ladder(grids, 1, ["product"]).collect())
    assert got == [("p", "a", 0, 1, 90, 90), ("p", "a", 1, 3, 30, 30), ("p", "a", 2, 2, 15, 15), ("p", "b", 1, 1, 30, 30), ("p", "b", 2, 2, 15, 15), ("q", "a", 0, 1, 40, 8), ("q", "a", 1, 2, 20, 4), ("q", "b", 0, 1, 8, 8), ("q", "b", 1, 2, 4, 4)]
    with pytest.raises(ValueError, match="product q"):
        ladders.ladder(grids.withColumn("pixel", F.expr("if(product = 'q' and component = 'b', 7.0, pixel)")), 1, ["product"])


def test_pyramid_of_thirds(spark):
    """72 x 72 cells in the ladder 1, 3, 9 make 24 x 24 and 8 x 8, by numpy."""
    import numpy as np

    rng = np.random.default_rng(1)
    fine, coarse = rng.integers(0, 9, (72, 73)).astype(float), rng.integers(0, 9, (24, 25)).astype(float)
    fine[rng.random(fine.shape) < 0.5] = -1.0
    fine[:9, :9] = -1.0
    rows = [(n, "p", i, j, float(a[i, j])) for n, a in (("a", fine), ("b", coarse)) for i in range(a.shape[0]) for j in range(a.shape[1])]
    cells = spark.createDataFrame(rows, "component string, product string, row long, col long, value double")
    grids = spark.createDataFrame([("p", "a", 10.0, 72, 73), ("p", "b", 30.0, 24, 25)], "product string, component string, pixel double, rows long, cols long")
    got = ladders.unified_pyramid(cells, ladders.ladder(grids, [30.0, 90.0], ["product"]), ["product", "component"], -1.0, integer=True).collect()

    def coarser(a, f):
        h, w = a.shape[0] // f, a.shape[1] // f
        b = a[: h * f, : w * f].reshape(h, f, w, f)
        n = (b != -1).sum((1, 3))
        return np.where(n > 0, np.trunc(np.where(b != -1, b, 0).sum((1, 3)) / np.maximum(n, 1)), -1)

    for name, levels in (("a", [fine, coarser(fine, 3), coarser(coarser(fine, 3), 3)]), ("b", [None, coarse, coarser(coarse, 3)])):
        for k, want in enumerate(levels):
            mine = {(r.row, r.col): r.value for r in got if r.component == name and r.level == k}
            assert len(mine) == (0 if want is None else want.size)
            assert all(want[at] == v for at, v in mine.items())
    assert {(r.component, r.level) for r in got} == {("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert ladders.unified_pyramid(cells.limit(0), ladders.ladder(grids.limit(0)), fill=-1.0).count() == 0


def test_shapes():
    assert [options.sides(s, (7, 8)) for s in (None, [], 5, [1, 2, 3], [[4, 6], [1, 1]], [9], " AUTO ")] == [(7, 8), (7, 8), (5, 5), (2, 3), (4, 6), (9, 9), "auto"]
    assert options.Store(levels=0).flat and not any(options.Store(levels=x).flat for x in (None, "auto", [20], False, 1))
    assert options.Store(chunk=[64, 32]).chunk_sides == (64, 32) and options.Store().shard_sides == "auto"


def test_cell_centres_of_rotated_grids(spark):
    made = spark.range(1).select(cell_centres(F.array(*[F.lit(x) for x in (0.0, 2.0, 0.0, 9.0, 0.0, -2.0)]), F.lit(1), F.lit(2)).alias("c"), cell_centres(F.array(*[F.lit(x) for x in (0.0, 2.0, 0.1, 9.0, 0.0, -2.0)]), F.lit(1), F.lit(2)).alias("turned")).first()
    assert [tuple(x) for x in made.c] == [("x", 0, 1.0), ("x", 1, 3.0), ("y", 0, 8.0)] and made.turned is None


def test_numbered_by_ranges(spark):
    rows = [(k % 3 if k % 10 else None, (k * 7919) % 1000) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g int, v int").repartition(7), ["v"], ["g"]).collect()
    assert len(got) == 1000
    for g in (None, 0, 1, 2):
        mine = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    # Columns of the caller stay, whatever they are called.
    kept = numbered(spark.createDataFrame([(3, 1, 5, 7, 8, 9), (3, 1, 4, 7, 8, 9)], "_range int, _by0 int, _n int, _before int, _at int, Place int"), ["_n"], ["_by0"], "place")
    assert kept.columns == ["_range", "_by0", "_n", "_before", "_at", "place"] and sorted(map(tuple, kept.collect())) == [(3, 1, 4, 7, 8, 0), (3, 1, 5, 7, 8, 1)]
    assert numbered(spark.createDataFrame([], "g int, v int"), ["v"], ["g"]).collect() == []
    assert sorted(r.n for r in numbered(spark.createDataFrame([(5,), (3,)], "v int"), ["v"], name="n").collect()) == [0, 1]


def test_mosaics(spark):
    src = spark.createDataFrame([(0, 0.0, 0.0, 20.0, 20.0, 10.0), (1, 20.0, -10.0, 40.0, 10.0, 10.0)], "o int, xmin double, ymin double, xmax double, ymax double, pixel double")
    assert sorted((r.o, r.col_off, r.row_off, r.mosaic_cols, r.mosaic_rows) for r in mosaic.placements(src, [], "o").collect()) == [(0, 0, 0, 4, 3), (1, 2, 1, 4, 3)]
    cells = spark.createDataFrame([("r", 0, 0, 0, 1.0), ("r", 1, 0, 0, 2.0), ("r", 2, 0, 0, 9.0), ("g", 0, 0, 0, 3.0), ("b", 0, 0, 1, 4.0), ("x", 0, 5, 5, 1.0)], "band string, ordinal int, row long, col long, value double").withColumns({"nodata": F.lit(9.0), "col_off": F.lit(1), "row_off": F.lit(2)})
    assert sorted(tuple(r) for r in mosaic.rgb(cells, ["r", "g", "b"]).collect()) == [(2, 1, 2.0, 3.0, 0.0), (2, 2, 0.0, 0.0, 4.0)]
    with pytest.raises(ValueError, match="3 bands"):
        mosaic.rgb(cells, ["r", "g"])
    m = spark.createDataFrame([("p", "a", 1, None), ("p", "b", 1, None), ("q", "a", 1, 0), ("q", "b", 2, None)], "p string, name string, grid int, missing int")
    got = {r.p: (r.members, r.grids, r.nodatas, r.stackable) for r in mosaic.homogeneity(m, ["p"], ["grid"], "missing").collect()}
    assert got == {"p": (2, 1, 1, True), "q": (2, 2, 2, False)}
    assert mosaic.require_one_grid(m.where("p = 'p'"), "name", ["grid"], "missing").count() == 2
    with pytest.raises(ValueError, match="several grids: grid=1: a; grid=2: b"):
        mosaic.require_one_grid(m.where("p = 'q'"), "name", ["grid"], "missing")
    with pytest.raises(ValueError, match="several no-data values"):
        mosaic.require_one_grid(m.where("name = 'a'"), "name", ["grid"], "missing")


def test_stores(spark):
    rows = [("B2/c/0/0", 5), ("B2/zarr.json", 1), ("0/B2/c/0", 10), ("1/B2/c/0", 4), ("2/B2/c/0", 1), ("0/x/c/0", 2), ("g/1/B2/c/0", 3), ("c/0", 7), ("B2/c/zarr.json", 1)]
    all_ = spark.createDataFrame(rows, "key string, size long")
    assert sorted((r.key, r.array, r.level) for r in store.shards(all_).collect()) == [("0/B2/c/0", "B2", 0), ("0/x/c/0", "x", 0), ("1/B2/c/0", "B2", 1), ("2/B2/c/0", "B2", 2), ("B2/c/0/0", "B2", 0), ("c/0", "", 0), ("g/1/B2/c/0", "B2", 0)]
    assert [(r.key, r.level) for r in store.shards(all_, "g", "B2").collect()] == [("g/1/B2/c/0", 1)]
    one = store.store_layout(store.shards(all_.where("key like '%/B2/c/0'"), array="B2").where("not key like 'g%'"), ["array"]).first()
    assert (one["shards"], one["size"], one.native_level, one.overview_bytes) == (3, 15, 0, 5)
    coarse = store.store_layout(store.shards(all_).where("level > 0"), ["array"]).first()
    assert (coarse.native_level, coarse.overview_bytes) == (1, 1)


def test_columns_of_point_clouds(spark):
    df = spark.createDataFrame([], "Longitude double, lat double, height double, sig0 double, cls int")
    assert points.pick_column(df, ["lon", "longitude"]) == "Longitude"
    with pytest.raises(KeyError, match="none of"):
        points.pick_column(df, ["depth"])
    geometry = ["Longitude", "lat", "height"]
    assert points.carried(df, geometry) == ["sig0", "cls"] and points.carried(df, geometry, ["cls", "nowhere", "sig0", "lat"]) == ["cls", "sig0"] and points.carried(df, geometry, [], ["cls"]) == [] and points.carried(df, geometry, None, ["sig0"]) == ["cls"]
    assert points.short_names(["abcdef", "abcdeg", "abcdeh", "x"], 5) == {"abcdef": "abcde", "abcdeg": "abc_1", "abcdeh": "abc_2", "x": "x"}
    cubes = protocol.random_cubes((0.0, 0.0, 5.0, 10.0, 10.0, 6.0), 4, 1)
    assert [c[:3] + c[4:6] for c in cubes] == protocol.random_boxes((0.0, 0.0, 10.0, 10.0), 4, 1) and {(c[3], c[6]) for c in cubes} == {(5.0, 6.0)}
    with pytest.raises(ValueError, match="have no geometry"):
        spatial.with_null_policy(spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (None,) * 4], "xmin double, ymin double, xmax double, ymax double"))


def test_options(spark):
    assert options.options_of(options.ArchiveBands, {"masks": ["CLM"]}).bands == ("B2", "B3", "B4", "B8")
    with pytest.raises(ValueError, match=r"unknown options \['band'\]"):
        options.options_of(options.ArchiveBands, {"band": []})
    nc = spark.createDataFrame([("/g/A.nc",)], "uri string")
    assert [r.address for r in options.read("cloud-groups", nc, {"include": [], "exclude": ["q"]}).collect()] == ["PIXC:/g/A.nc::pixel_cloud?include=&exclude=q"]
    assert set(options.OPTIONS) == set(readers.names()) and layouts.get("columnar").kind is options.Kind.VECTOR


def test_a_run_from_table_to_report(spark, tmp_path):
    boxes = spark.range(200).select(*[F.col("id").cast("double").alias(c) for c in spatial.BOX])
    got = run.conversion(boxes, "columnar", f"{tmp_path}/out", {"partitions": 2}, bytes_in=1000, metrics=["bytes_out", "bytes_in"])
    sizes = [r["size"] for r in got["objects"].collect()]
    assert len(sizes) == 2 and all(k.endswith(".parquet") for k in (r.key for r in got["objects"].collect()))
    assert {r.metric: r.value for r in got["metrics"].collect()} == {"bytes_out": float(sum(sizes)), "bytes_in": 1000.0}
    assert sum(r.rows for r in got["layout"].collect()) == 200 and got["profile"].first().total_bytes == sum(sizes)
    lines = [r.line for r in got["summary"].orderBy("part", "line_no").collect()]
    assert lines[0] == "# columnar" and "| Objects | 2 |" in lines and "| bytes_in | 1000.00 | B |" in lines
    report.write_product_set(got["summary"].withColumn("product", F.lit("p1")), f"{tmp_path}/set")
    assert [r.value for r in spark.read.text(f"{tmp_path}/set/product=p1").collect()][:1] == ["# columnar"]
    with pytest.raises(ValueError, match="unknown options"):
        run.timed_write(boxes, "columnar", f"{tmp_path}/no", {"levers": 1})
    assert run.product_limit("product", None) == 1 and run.product_limit("product", 3) == 3 and run.product_limit("set", None) is None


def test_conditions_are_assembled(spark):
    rows = [("read", "warm", 2, 0, 0, "s", 1.0, None), ("read", "warm", 2, 0, 1, "s", 3.0, None), ("read", "warm", 2, 1, 0, "s", 5.0, None), ("read", "cold", 1, 0, 0, "read_condition_skipped", None, "broken")]
    got = {r.cache: r for r in run.assemble_conditions(spark.createDataFrame(rows, protocol.MEASURED)).collect()}
    assert [(r.replicate, [(m.key, m.value) for m in r.metrics]) for r in got["warm"].replicates] == [(0, [("s", 2.0)]), (1, [("s", 5.0)])]
    assert got["cold"].replicates == [] and got["cold"].error == "broken"


def test_archives_up_to_a_limit_and_footers(spark, tmp_path):
    import zipfile

    for name in ("b", "a", "c d"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.tif", "xyz")
    assert sorted((r.member, r["size"]) for r in listing.zip_members(spark, str(tmp_path), limit=2).collect()) == [("a.tif", 3), ("b.tif", 3)]
    assert listing.zip_members(spark, str(tmp_path)).count() == 3
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = listing.parquet_layout(spark, f"{tmp_path}/t").first()
    assert (one.rows, one.row_groups, one.codec, one.geo) == (10, 1, "snappy", None)
