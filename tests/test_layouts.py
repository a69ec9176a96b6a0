"""Layout records of all kinds in one table: details by name, tables by kind, the report."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import layouts


@pytest.fixture(scope="module")
def rows(spark):
    raster = layouts.records(spark.createDataFrame([("a", 2048, True, 256, 256, 2, 64, ["x", "y"]), ("b", 10, False, 1, 512, 0, 9, None)], "name string, size long, tiled boolean, block_rows int, block_cols int, overviews int, tiles long, bands array<string>"), "raster")
    store = layouts.records(spark.createDataFrame([("s", 1000, "zstd", 2.0, [64, 64], [256, 100], 1, 4, 1, 250, "int16", True, "grid0")], "name string, size long, codec string, ratio double, chunk array<int>, shard array<int>, levels int, shards long, native_level int, overview_bytes long, stored string, unscaled boolean, grid string"), "store")
    tree = layouts.records(spark.createDataFrame([("t", 7, 3, 2)], "name string, size long, nodes long, depth int"), "octree")
    return layouts.united([raster, store, tree])


def test_one_table(rows, spark, tmp_path):
    assert rows.columns == ["name", "kind", "size", "codec", "ratio", "details"] and rows.schema["details"].dataType.typeName() == "variant"
    got = {r.name: r for r in rows.select("name", "kind", layouts.detail("tiles", "long").alias("tiles"), layouts.detail("nodes", "long").alias("nodes"), layouts.detail("tiles", "boolean").alias("wrong")).collect()}
    assert (got["a"].tiles, got["a"].nodes, got["t"].nodes, got["s"].tiles) == (64, None, 3, None)
    # A table with a column of its own is united by name.
    more = layouts.united([rows, rows.limit(1).withColumn("run", F.lit("r")).select("run", "details", "name", "kind", "size", "codec", "ratio")])
    assert more.count() == 5 and more.where("run is null").count() == 4
    rows.write.parquet(str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where(layouts.detail("depth", "int") == 2).first().name == "t"
    with pytest.raises(ValueError, match="unknown kind"):
        layouts.records(rows, "tape")
    with pytest.raises(ValueError, match="nothing is told"):
        layouts.records(rows.select("name", "size"), "octree")
    with pytest.raises(ValueError, match="no records"):
        layouts.united([])


def test_tables(rows):
    lines = lambda f, kind: [r.line for r in f(rows, kind).orderBy("line").collect()]
    assert lines(layouts.cells, "raster") == ["| a | yes | 256x256 | 2 | 64 | x, y | 2.0 KiB | - | - |", "| b | no | 1x512 | 0 | 9 | - | 10 B | - | - |"]
    assert lines(layouts.totals, "raster") == ["* 1 objects hold several components, a band each", "* 1 of 2 objects are tiled, 1 in strips"]
    assert lines(layouts.cells, "store") == ["| s | 64x64 | 256x100 | 4 | 1 | 4 | unscaled by readers as int16 | grid0 | 1 native, 2 to 2 derived | 1000 B | zstd | 2.00x |"]
    assert lines(layouts.totals, "store") == ["* 1 arrays are scaled by their own codec", "* 1 arrays share 1 grids", "* 4 shards in 1 arrays", "* Overviews are 250 B of 1000 B, 25.0 %"]
    assert lines(layouts.cells, "octree") == ["| t | 3 | 2 | - | - | 0 | 7 B | - | - |"]
    assert lines(layouts.totals, "octree") == ["* 3 nodes in 1 files", "* Points carry nothing but their place"] and lines(layouts.totals, "indexed") == []


def test_report(rows):
    got = [r.line for r in layouts.report(rows).orderBy("part", "line_no").collect()]
    assert [x for x in got if x.startswith("## ")] == ["## Tiling", "## Chunks and shards", "## Octree"]
    at = got.index("## Tiling")
    assert got[at + 1 : at + 8] == ["", "* 1 of 2 objects are tiled, 1 in strips", "* 1 objects hold several components, a band each", "", "| name | tiled | block | overviews | tiles | bands | size | codec | ratio |", "| --- | --- | --- | --- | --- | --- | --- | --- | --- |", "| a | yes | 256x256 | 2 | 64 | x, y | 2.0 KiB | - | - |"]
    assert layouts.report(rows.limit(0)).count() == 0


def test_written_layouts(spark, tmp_path):
    """Records of what each layout wrote, and the data back."""
    from quarry.operators import run
    from quarry.sources import stored  # noqa: F401
    from quarry.sources.options import Kind
    from quarry.sources.registry import layouts as kinds

    assert kinds.names() == ["columnar", "indexed", "octree", "store"] and kinds.get("store").kind is Kind.STORE
    cells = spark.createDataFrame([(c, i, j, float(i * j) if i != j else -1.0) for c, n in (("a", 12), ("b", 4)) for i in range(n) for j in range(n)], "component string, row int, col int, value double").withColumn("pixel", F.expr("if(component = 'a', 1.0, 3.0)"))
    kinds.get("store").write(cells, str(tmp_path / "s"), kinds.get("store").options(chunk=4, shard=[8, 4], levels=[3.0, 6.0]))
    got = {r.name: r for r in kinds.get("store").records(spark, str(tmp_path / "s")).select("name", "size", *[layouts.detail(n, t).alias(n) for n, t in (("levels", "int"), ("shards", "long"), ("native_level", "int"), ("overview_bytes", "long"), ("chunk", "array<int>"), ("shard", "array<int>"))]).collect()}
    # a: 12 x 12 in 2 x 3 shards, 4 x 4 and 2 x 2 in one each; b: 4 x 4 and 2 x 2.
    assert (got["a"].levels, got["a"].shards, got["a"].native_level, got["a"].chunk, got["a"]["shard"]) == (2, 8, 0, [4, 4], [8, 4])
    assert (got["b"].levels, got["b"].shards, got["b"].native_level) == (1, 2, 1) and 0 < got["a"].overview_bytes < got["a"]["size"]
    back = spark.read.parquet(str(tmp_path / "s/arrays")).where("component = 'a' and level = 0").select("chunk_row", "chunk_col", F.explode("cells").alias("c"))
    assert {(r.chunk_row * 4 + r.c.row, r.chunk_col * 4 + r.c.col): r.c.value for r in back.collect()} == {(r.row, r.col): r.value for r in cells.where("component = 'a'").collect()}
    kinds.get("store").write(cells.where("component = 'b'"), str(tmp_path / "f"), kinds.get("store").options(chunk=2, levels=0))
    assert kinds.get("store").records(spark, str(tmp_path / "f")).select(layouts.detail("levels", "int"), layouts.detail("shards", "int")).first() == (0, 1)
    features = spark.createDataFrame([(k, *((None,) * 4 if k % 5 == 0 else (float(k), 0.0, k + 1.0, 1.0)), float(k), 2.0) for k in range(100)], "id int, xmin double, ymin double, xmax double, ymax double, lon double, lat double")
    for policy, n in (("drop", (80, 20, 0, 0)), ("point_from", (100, 0, 20, 0)), ("sentinel", (100, 0, 0, 20))):
        kinds.get("indexed").write(features, str(tmp_path / policy), kinds.get("indexed").options(null_geometry=policy, lon="lon", lat="lat"))
        assert tuple(kinds.get("indexed").records(spark, str(tmp_path / policy)).select(*[layouts.detail(c, "long") for c in ("features", "dropped", "made", "placed")]).first()) == n
    with pytest.raises(ValueError, match="have no geometry"):
        kinds.get("indexed").write(features, str(tmp_path / "e"), kinds.get("indexed").options())
    cloud = spark.createDataFrame([(k, k * 0.1, k * 0.2, 0.0, k % 3, "x") for k in range(50)], "pid long, x double, y double, z double, cls int, depth string")
    out = run.conversion(cloud, "octree", str(tmp_path / "o"), {"span": 2})
    assert out["records"].select(layouts.detail("points", "long"), layouts.detail("carried", "array<string>")).first() == (50, ["cls", "depth"])
    assert out["profile"].first().object_count > 0


def test_writers_grow_with_rows(spark, tmp_path, monkeypatch):
    """Tasks that write a store are as many as its cells ask for, each shard in one file; a curve over one partition is worked out by several tasks."""
    from quarry.operators import raster, rtree, spatial
    from quarry.sources import stored  # noqa: F401
    from quarry.sources.registry import layouts as kinds

    monkeypatch.setattr(raster, "TASK_ROWS", 50)
    cells = spark.range(400).select(F.lit("a").alias("component"), F.expr("id div 20").alias("row"), (F.col("id") % 20).alias("col"), F.col("id").cast("double").alias("value"))
    kinds.get("store").write(cells, str(tmp_path / "s"), kinds.get("store").options(chunk=2, shard=4, levels=0))
    files = spark.read.parquet(str(tmp_path / "s/arrays")).select("shard_row", "shard_col", F.input_file_name().alias("file"), F.size("cells").alias("n")).distinct().collect()
    assert len({r.file for r in files}) >= 4 and len(files) == len({(r.shard_row, r.shard_col) for r in files}) == 25 and {r.n for r in files} == {4}
    monkeypatch.setattr(spatial, "TASK_FEATURES", 10, raising=False)
    seen = []
    cut = lambda df, name: (seen.append((name, df.rdd.getNumPartitions())), df)[1]
    features = spark.range(0, 95, 1, 1).select("id", *[(F.col("id") % 7 + k).cast("double").alias(c) for k, c in enumerate(spatial.BOX)])
    assert rtree.in_order(features, ["id"], cut=cut).count() == 95 and ("rtree-features", 10) in seen
    assert spatial.clustered(features, 2, cut=cut).count() == 95 and seen[-1] == ("curve", 10)
