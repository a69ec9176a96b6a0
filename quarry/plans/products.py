"""More queries over whole tables: readers, grids, mosaics, stores, point clouds, reports; with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import grid, uri
from quarry.operators import ladders, measure, mosaic, points, raster, report, rtree, run, spatial, store
from quarry.operators import product_run as runs
from quarry.plans import views
from quarry.plans.tables import shared_dir
from quarry.plans.queries import _BOXES, _KEYS, _MERGED, ORACLE, query, rounded
from quarry.plans.views import FILL, SIDE, SQL, with_views
from quarry.sources.options import read

# Readers.


def _members(spark, d):
    kinds = [f"S/A_{x}" for x in ("FRE_B2.tif", "FRE_B5.tif", "SRE_B2.tif", "fre_b8.TIF")] + ["S/MASKS/A_CLM_R1.tif", "S/MASKS/A_SAT_R2.tif", "S/a_vv_GAM_x.tif", "S/A_VH_GAM_y.tif", "S/l.shp", "S/l.shp.xml"]
    n = F.col("doc_id")
    return views.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/d/"), "source", F.lit("-"), n, F.lit(".zip")).alias("uri"), F.array(*[F.lit(k) for k in kinds])[(n % len(kinds)).cast("int")].alias("member"))


_MEMBERS = "members as (select doc_id, source || '-' || doc_id as product, (['S/A_FRE_B2.tif','S/A_FRE_B5.tif','S/A_SRE_B2.tif','S/A_fre_b8.TIF','S/MASKS/A_CLM_R1.tif','S/MASKS/A_SAT_R2.tif','S/a_vv_GAM_x.tif','S/A_VH_GAM_y.tif','S/l.shp','S/l.shp.xml'])[doc_id % 10 + 1] as member from documents)"


@query(f"with {_MEMBERS} select product, member, case doc_id % 10 when 0 then 'B2' when 3 then 'B8' else 'CLM_R1' end as component, doc_id % 10 = 4 as is_mask, case when doc_id % 10 <> 4 then -10000.0::double end as nodata, case when doc_id % 10 <> 4 then 0.0001::double end as scale from members where doc_id % 10 in (0, 3, 4)")
def reader_archive_bands(spark, d):
    out = read("archive-bands", _members(spark, d), {"bands": ["B2", "B8"], "masks": ["CLM"]})
    return out.select("product", "member", "component", "is_mask", "nodata", "scale")


@query(f"with {_MEMBERS} select product, member, case doc_id % 10 when 6 then 'VV' else 'VH' end as component, case doc_id % 10 when 6 then 2 else 1 end::bigint as place from members where doc_id % 10 in (6, 7)")
def reader_polarisations(spark, d):
    return read("radar-polarisations", _members(spark, d), {"polarisations": ["VH", "VV"]}).select("product", "member", "component", F.col("place").cast("long"))


@query(f"with {_MEMBERS} select product, 'l' as component from members where doc_id % 10 = 8")
def reader_shapes(spark, d):
    return read("shape-archives", _members(spark, d)).select("product", "component")


@query("""select doc_id::varchar as product, place, (['wse', 'area'])[place + 1] as component, 'NETCDF:"/g/' || doc_id || '.nc":' || (['wse', 'area'])[place + 1] as address, '/g/' || doc_id || '.nc' as container from documents, (values (0), (1)) p(place)""")
def reader_variables(spark, d):
    granules = views.table(spark, d, "documents").select(F.concat(F.lit("/g/"), "doc_id", F.lit(".nc")).alias("uri"))
    out = read("granule-variables", granules, {"variables": ["wse", "area"]})
    return out.select("product", "place", "component", "address", uri.netcdf_container(F.col("address")).alias("container"))


@query("select case when doc_id % 2 = 0 then 'L_' || (20200000 + doc_id) || '_x' else 'L' || doc_id end as product, case when doc_id % 2 = 0 then (20200000 + doc_id)::varchar else 'L' || doc_id end as component from documents where doc_id % 3 <> 0")
def reader_dates(spark, d):
    n = F.col("doc_id")
    name = F.when(n % 2 == 0, F.concat(F.lit("L_"), n + 20200000, F.lit("_x"))).otherwise(F.concat(F.lit("L"), n))
    files = views.table(spark, d, "documents").select(F.concat(F.lit("/l/"), name, F.when(n % 3 != 0, ".tif").otherwise(".txt")).alias("uri"))
    return read("dated-granules", files).select("product", "component")


@query("select '/g/' || source || '::x/' || doc_id || '.nc' as granule, 'pixel_cloud' as \"group\", case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else 'h,' || lang end as include, case when doc_id % 2 = 0 then 'q' else '' end as exclude, 'PIXC:/g/' || source || '::x/' || doc_id || '.nc::' || case when doc_id % 5 = 0 then '' else 'pixel_cloud' end || case when doc_id % 3 = 0 and doc_id % 2 = 1 then '' else '?' || concat_ws('&', case when doc_id % 3 = 1 then 'include=' when doc_id % 3 = 2 then 'include=h,' || lang end, case when doc_id % 2 = 0 then 'exclude=q' end) end as address from documents")
def cloud_addresses(spark, d):
    n = F.col("doc_id")
    nothing = F.array().cast("array<string>")
    made = uri.cloud_address(F.concat(F.lit("/g/"), "source", F.lit("::x/"), n, F.lit(".nc")), F.when(n % 5 == 0, "").otherwise("pixel_cloud"), F.when(n % 3 == 1, nothing).when(n % 3 == 2, F.array(F.lit("h"), F.col("lang"))), F.when(n % 2 == 0, F.array(F.lit("q"))).otherwise(nothing))
    got = views.table(spark, d, "documents").select(made.alias("address")).withColumn("p", uri.parse_cloud_address(F.col("address")))
    return got.select("p.granule", "p.group", F.array_join("p.include", ",").alias("include"), F.array_join("p.exclude", ",").alias("exclude"), "address")


@query("select doc_id, regexp_replace('/a/' || source, '/+$', '') || '/' || lang as joined, '/vsizip//d/' || source || '.zip/' || lang || '.tif' as member, case when doc_id % 2 = 0 then 32600 + doc_id % 60 end::int as epsg, doc_id % 3 = 0 as projected from documents")
def address_functions(spark, d):
    n = F.col("doc_id")
    crs = F.concat(F.when(n % 3 == 0, 'PROJCRS["x",').otherwise('GEOGCRS["x",'), F.when(n % 2 == 0, F.concat(F.lit('ID["EPSG",4326],ID["EPSG",'), 32600 + n % 60, F.lit("]"))).otherwise(""), F.lit("]"))
    return views.table(spark, d, "documents").select("doc_id", uri.join_uri(F.concat(F.lit("/a/"), "source", F.lit("//")), F.col("lang")).alias("joined"), uri.member_uri(F.concat(F.lit("/d/"), "source", F.lit(".zip")), F.concat("lang", F.lit(".tif"))).alias("member"), uri.epsg_of(crs).alias("epsg"), grid.is_projected(crs).alias("projected"))


# Grids and ladders.


@query("select p_partkey, axis, place, (case when axis = 'x' then p_size + (place + 0.5) * 10 else 100 - (place + 0.5) * 10 end)::double as centre from part, (values ('x', 5), ('y', 3)) a(axis, n), range(5) r(place) where place < n and p_partkey % 4 <> 0")
def cell_centres(spark, d):
    gt = F.array(F.col("p_size").cast("double"), F.lit(10.0), F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(0.0), F.lit(100.0), F.lit(0.0), F.lit(-10.0))
    return views.table(spark, d, "part").select("p_partkey", F.explode(grid.cell_centres(gt, F.lit(3), F.lit(5))).alias("c")).select("p_partkey", "c.*")


@query("select p_partkey, 10.0::double as pixel, 20.0::double as coarser, p_size::double as xmin, (100 - 100 * p_size)::double as ymin, (p_size + 200 * p_size)::double as xmax, 100.0::double as ymax, greatest(0, floor(log2(greatest(1, (p_size * 10) // 256))))::int as depth, least(greatest(64, 1), p_size * 20)::bigint as chunk, (ceil(p_size * 20 / 64.0) * 64)::bigint as shard from part")
def grid_algebra(spark, d):
    size = F.col("p_size").cast("double")
    gt = grid.parse_geotransform(F.concat_ws(" ", size, F.lit("10.0 0 100.0 0 -10.0")))
    box = grid.bounds(gt, F.col("p_size") * 10, F.col("p_size") * 20)
    wide = (F.col("p_size") * 20).cast("long")
    return views.table(spark, d, "part").select("p_partkey", grid.pixel_size(gt).alias("pixel"), grid.pixel_size(grid.decimate(gt, F.lit(2))).alias("coarser"), box["xmin"].alias("xmin"), box["ymin"].alias("ymin"), box["xmax"].alias("xmax"), box["ymax"].alias("ymax"), grid.auto_depth(F.col("p_size") * 10, wide).alias("depth"), grid.fit_chunk(F.lit(64).cast("long"), wide).alias("chunk"), grid.auto_shard(wide, F.lit(64)).cast("long").alias("shard"))


_MEAN = f"coalesce(avg(case when value <> {FILL} then value end), {FILL})"


@query(None)
def pyramid_by_resolutions(spark, d):
    """A pyramid of given pixel sizes, 20 and 80 units above cells of 10."""
    grids = spark.createDataFrame([("all", 10.0, SIDE, SIDE)], "component string, pixel double, rows long, cols long")
    cells = views.cells(spark, d).withColumn("component", F.lit("all"))
    return rounded(ladders.unified_pyramid(cells, ladders.ladder(grids, [20.0, 80.0]), fill=FILL).where("level > 0").drop("component"))


ORACLE["pyramid_by_resolutions"] = with_views("", "cells").rstrip() + f', a as (select "row" // 2 as "row", col // 2 as col, {_MEAN} as value from cells group by 1, 2), b as (select "row" // 4 as "row", col // 4 as col, {_MEAN} as value from a group by 1, 2) select 1 as level, "row", col, round(value, 6) as value from a union all select 2, "row", col, round(value, 6) from b'


@query(None)
def unified_pyramid(spark, d):
    """Two components of unlike pixel sizes in one ladder: one from level 0, one from level 1, both to level 2."""
    grids = spark.createDataFrame([("fine", 10.0, SIDE, SIDE), ("coarse", 20.0, SIDE // 2, SIDE // 2)], "component string, pixel double, rows long, cols long")
    cells = views.cells(spark, d)
    half = raster.block_mean(cells, 2, SIDE, SIDE, FILL).withColumn("component", F.lit("coarse"))
    return rounded(ladders.unified_pyramid(cells.withColumn("component", F.lit("fine")).unionByName(half), ladders.ladder(grids, 1), fill=FILL))


ORACLE["unified_pyramid"] = with_views("", "cells").rstrip() + f', a as (select "row" // 2 as "row", col // 2 as col, {_MEAN} as value from cells group by 1, 2), b as (select "row" // 2 as "row", col // 2 as col, {_MEAN} as value from a group by 1, 2), u as (select \'fine\' as component, 0 as level, "row", col, value from cells union all select component, 1, "row", col, value from a, (values (\'fine\'), (\'coarse\')) k(component) union all select component, 2, "row", col, value from b, (values (\'fine\'), (\'coarse\')) k(component)) select component, level, "row", col, round(value, 6) as value from u'


def _growing(spark, d):
    """Three components whose sides grow with the table: one of pixels of 10, two of pixels of 30."""
    line = views.table(spark, d, "lineitem")
    per = F.when(F.col("l_returnflag") == "A", 1).otherwise(3)
    at = lambda c: F.floor(F.col(c) / per).cast("long")
    own = raster.dealt(line.withColumns({"component": F.col("l_returnflag"), "row": at("l_partkey"), "col": at("l_suppkey")}), "component", "row", "col").groupBy("component", "row", "col").agg(F.avg("l_quantity").alias("value"))
    return own.withColumn("value", F.when((F.col("row") + F.col("col")) % 7 == 0, FILL).otherwise(F.col("value")))


@query(None)
def pyramid_bundle(spark, d):
    """Components of two pixel sizes in the ladder 1, 3, 9, each from its own level on; rasters as large as the table's keys."""
    cells = _growing(spark, d)
    shape = cells.groupBy("component").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    grids = shape.withColumn("pixel", F.when(F.col("component") == "A", 10.0).otherwise(30.0))
    return rounded(ladders.unified_pyramid(cells, ladders.ladder(grids, [30.0, 90.0]), fill=FILL))


_STEP = "{name} as (select component, \"row\" // 3 as \"row\", col // 3 as col, {mean} as value from {of} join side using (component) where \"row\" < side.{side}r // 3 * 3 and col < side.{side}c // 3 * 3 group by 1, 2, 3)"
ORACLE["pyramid_bundle"] = (
    f"with raw as (select l_returnflag as component, l_partkey // case when l_returnflag = 'A' then 1 else 3 end as \"row\", l_suppkey // case when l_returnflag = 'A' then 1 else 3 end as col, avg(l_quantity) as value from lineitem group by 1, 2, 3), own as (select component, \"row\", col, case when (\"row\" + col) % 7 = 0 then {FILL} else value end as value from raw), "
    "side as (select component, max(\"row\") + 1 as r, max(col) + 1 as c, (max(\"row\") + 1) // 3 as halfr, (max(col) + 1) // 3 as halfc from own group by component), "
    + _STEP.format(name="once", mean=_MEAN, of="own", side="")
    + ", "
    + _STEP.format(name="twice", mean=_MEAN, of="once", side="half")
    + " select component, case component when 'A' then k else k + 1 end::int as level, \"row\", col, round(value, 6) as value from (select 0 as k, * from own union all select 1, * from once union all select 2, * from twice) where component = 'A' or k < 2"
)


@query('with c as (select l_partkey as "row", l_suppkey as col, l_returnflag as component, case when (l_partkey // p + l_suppkey // p) % 7 = 0 then 1 else 0 end as odd, l_quantity from (select *, case when l_returnflag = \'A\' then 1 else 3 end as p from lineitem)), x as (select "row", col, avg(l_quantity) as value from c where component = \'A\' group by all), side as (select max("row") + 1 as r, max(col) + 1 as c from x), w as (select k, (r - 50) * k // 8 as r0, greatest(0, c - 20) * k // 8 as c0 from side, range(8) t(k)) select k::int as "window", count(*) as cells, round(sum(case when ("row" + col) % 7 = 0 then -10000.0 else value end), 6) as total from w join x on "row" >= r0 and "row" < r0 + 50 and col >= c0 and col < c0 + 20 group by k')
def window_read_growing(spark, d):
    """Eight windows down the diagonal of a raster as large as the table's keys."""
    cells = _growing(spark, d).where("component = 'A'").drop("component")
    r, c = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    windows = [(k, (r - 50) * k // 8, max(0, c - 20) * k // 8, 50, 20) for k in range(8)]
    return rounded(raster.window_reads(cells, windows).groupBy("window").agg(F.count("*").alias("cells"), F.sum("value").alias("total")))


_SOURCES = "select l_linenumber as ordinal, l_partkey as \"row\", l_suppkey as col, max(case when (l_partkey + l_suppkey + l_linenumber) % 5 = 0 then -1.0 else l_quantity end)::double as value from lineitem group by all"


def _sources(spark, d):
    """Seven sources on one grid as large as the table's keys."""
    there = F.when((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 5 == 0, -1.0).otherwise(F.col("l_quantity").cast("double"))
    line = raster.dealt(views.table(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    return line.groupBy(F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.max(there).alias("value"))


@query(f'select "row", col, arg_max(value, ordinal) as value from ({_SOURCES}) where value <> -1 group by all')
def mosaic_growing(spark, d):
    """Later sources over earlier ones where they have data."""
    return raster.mosaic(_sources(spark, d), -1.0)


@query(f'select "row", col, ' + ", ".join(f'max(value) filter (ordinal = {k}) as "{k}"' for k in range(1, 8)) + f" from ({_SOURCES}) group by all")
def stack_growing(spark, d):
    """A band for each source."""
    return raster.stack(_sources(spark, d).withColumnRenamed("ordinal", "band"), list(range(1, 8)))


@query(f'select "row" // 16 // 4 as shard_row, col // 16 // 4 as shard_col, count(*) as chunks, count(*) * 2048 as size from (select "row" // 16 * 16 as "row", col // 16 * 16 as col from ({_SOURCES}) where ordinal = 1 group by 1, 2 having count(*) filter (value <> -1) > 0) group by all')
def shards_growing(spark, d):
    """Objects of the first source as a store: chunks of 16 x 16, 4 x 4 of them a shard."""
    return raster.shard_objects(_sources(spark, d).where("ordinal = 1"), 16, 4, 8, -1.0)


@query("select l_returnflag, l_linestatus, count(*) as reads, round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as p50, round(stddev_pop(l_quantity), 6) as spread, round(sum(l_linenumber * 24) / sum(l_quantity), 6) as throughput, sum(l_linenumber)::bigint as l_linenumber from lineitem group by all")
def point_read_summary(spark, d):
    """Reads of points: how many came, 24 bytes each."""
    return rounded(measure.latency_summary(views.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", "l_linenumber", points.POINT_BYTES))


@query("select l_linestatus, count(*) as reads, round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as p50, round(stddev_pop(l_quantity), 6) as spread, round(sum(l_extendedprice) / sum(l_quantity), 6) as throughput, sum(l_linenumber)::bigint as l_linenumber from lineitem group by all")
def feature_read_summary(spark, d):
    """Reads of features: how many came, and the bytes that they hold."""
    return rounded(measure.latency_summary(views.table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice", "l_linenumber"))


# Mosaics and stacks.


@query("with s as (select s_nationkey, s_suppkey, (s_suppkey % 50) * 10.0 as xmin, (s_suppkey % 30) * 10.0 - 150 as ymin, (s_suppkey % 50) * 10.0 + 200 as xmax, (s_suppkey % 30) * 10.0 as ymax from supplier) select s_nationkey, s_suppkey, round_even((xmin - min(xmin) over w) / 10, 0)::bigint as col_off, round_even((max(ymax) over w - ymax) / 10, 0)::bigint as row_off, round_even((max(xmax) over w - min(xmin) over w) / 10, 0)::bigint as mosaic_cols, round_even((max(ymax) over w - min(ymin) over w) / 10, 0)::bigint as mosaic_rows from s window w as (partition by s_nationkey)")
def mosaic_placement(spark, d):
    left, top = (F.col("s_suppkey") % 50 * 10.0), (F.col("s_suppkey") % 30 * 10.0)
    own = views.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", left.alias("xmin"), (top - 150).alias("ymin"), (left + 200).alias("xmax"), top.alias("ymax"), F.lit(10.0).alias("pixel"))
    return mosaic.placements(own, ["s_nationkey"], "s_suppkey").select("s_nationkey", "s_suppkey", "col_off", "row_off", "mosaic_cols", "mosaic_rows")


@query(None)
def mosaic_rgb(spark, d):
    """Three bands of seven overlapping sources: each lies 10 cells to the right of the one before it."""
    line = views.table(spark, d, "lineitem")
    cells = line.groupBy(F.col("l_returnflag").alias("band"), F.col("l_linenumber").alias("ordinal"), (F.col("l_orderkey") % SIDE).alias("row"), (F.col("l_partkey") % SIDE).alias("col")).agg(F.max("l_quantity").alias("value"))
    edge = F.col("ordinal") * 100.0
    sources = cells.select("ordinal").distinct().select("ordinal", edge.alias("xmin"), F.lit(0.0).alias("ymin"), (edge + SIDE * 10).alias("xmax"), F.lit(SIDE * 10.0).alias("ymax"), F.lit(10.0).alias("pixel"))
    placed = mosaic.placements(sources, [], "ordinal").select("ordinal", "col_off", "row_off")
    return mosaic.rgb(cells.join(placed, "ordinal").withColumn("nodata", F.lit(1.0)), ["A", "N", "R"], -1.0)


ORACLE["mosaic_rgb"] = f"""with c as (select l_returnflag as band, l_linenumber as ordinal, l_orderkey % {SIDE} as r, l_partkey % {SIDE} as c, max(l_quantity)::double as value from lineitem group by all), p as (select *, (c + 10 * (ordinal - (select min(ordinal) from c)))::bigint as x from c where value <> 1)
select r as "row", x as col, coalesce(arg_max(value, ordinal) filter (band = 'A'), -1) as red, coalesce(arg_max(value, ordinal) filter (band = 'N'), -1) as green, coalesce(arg_max(value, ordinal) filter (band = 'R'), -1) as blue from p group by 1, 2"""


@query("with m as (select p_brand, p_size % 2 as g, case when p_partkey % 5 = 0 then 7 when p_size > 25 then 1 end as missing from part) select p_brand, count(*) as members, count(distinct g) as grids, count(distinct coalesce(missing, -1)) as nodatas, count(distinct g) = 1 and count(distinct coalesce(missing, -1)) = 1 as stackable from m group by p_brand")
def stack_homogeneity(spark, d):
    own = views.table(spark, d, "part").withColumns({"grid": F.col("p_size") % 2, "missing": mosaic.nodata_of(F.when(F.col("p_partkey") % 5 == 0, 7), F.when(F.col("p_size") > 25, 1), F.lit(None).cast("int"))})
    return mosaic.homogeneity(own, ["p_brand"], ["grid"], "missing")


# Stores.


def _listing(spark, d):
    n = F.col("doc_id")
    key = F.concat_ws("/", (n % 3).cast("string"), "lang", F.when(n % 7 == 0, "zarr.json").otherwise(F.concat(F.lit("c/0/"), n)))
    return views.table(spark, d, "documents").select("source", key.alias("key"), F.col("n_chars").cast("long").alias("size"), (F.col("n_chars") * 2).cast("long").alias("raw"))


@query("with s as (select source, lang as \"array\", doc_id % 3 as level, n_chars as size from documents where doc_id % 7 <> 0), t as (select source, \"array\", level, count(*) as n, sum(size) as bytes from s group by all) select source, \"array\", sum(n)::bigint as shards, sum(bytes)::bigint as size, min(level)::int as native_level, (sum(bytes) - arg_min(bytes, level))::bigint as overview_bytes, round((sum(bytes) - arg_min(bytes, level)) / sum(bytes), 6) as overview_share, 2.0::double as ratio from t group by source, \"array\"")
def store_layouts(spark, d):
    return rounded(store.store_layout(store.shards(_listing(spark, d)), ["source", "array"], "raw"))


@query("select source, lang as \"group\", min(doc_id % 4)::int as finest, bool_or(doc_id % 11 = 0) as unified from documents group by source, lang")
def finest_levels(spark, d):
    n = F.col("doc_id")
    own = views.table(spark, d, "documents").select("source", "lang", (n % 4).cast("string").alias("group"), F.lit(False).alias("has_scales"))
    root = views.table(spark, d, "documents").select("source", "lang", F.lit("").alias("group"), (n % 11 == 0).alias("has_scales"))
    return store.finest_level(own.unionByName(root), ["source", "lang"]).select("source", F.col("lang").alias("group"), "finest", "unified")


@query("select p_partkey, case when p_size % 3 = 0 then 99.0 else least(p_size, 20) end::double as resolution from part")
def level_resolutions(spark, d):
    a = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    return views.table(spark, d, "part").select("p_partkey", store.level_resolution(a, F.lit(-20.0), F.lit(99.0)).alias("resolution"))


@query("select p_brand, count(*) as objects, count(*) filter (p_size > 25) as tiled, sum(p_size)::bigint as shards, count(distinct p_size % 4) as grids, round(100.0 * sum(p_size) / sum(p_size * 10), 6) as overview_share, round(coalesce(100.0 * sum(p_size) filter (p_size % 2 = 0), 0) / sum(p_size * 10), 6) as index_share, count(*) filter (p_partkey % 3 = 0) as with_box, count(distinct p_type) as carried from part group by p_brand")
def layout_totals(spark, d):
    s = F.col("p_size").cast("long")
    own = views.table(spark, d, "part").select("p_brand", (s > 25).alias("tiled"), s.alias("shards"), (s % 4).alias("grid"), s.alias("overview_bytes"), F.when(s % 2 == 0, s).alias("index_bytes"), (s * 10).alias("size"), (F.col("p_partkey") % 3 == 0).alias("has_box"), F.array("p_type").alias("carried"))
    return rounded(store.layout_totals(own, ["p_brand"]))


# Features, points, measurements.


@query("select id, lon as xmin, lat as ymin, lon + case id % 3 when 0 then 0 else 0.5 end as xmax, lat + case id % 3 when 0 then 0 else 0.5 end as ymax from features", "features")
def smallest_geometries(spark, d):
    family = F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("MultiPolygon")), (F.col("id") % 3 + 1).cast("int"))
    return views.features(spark, d).select("id", spatial.smallest_geometry(family, F.col("lon"), F.col("lat"), 0.5).alias("g")).select("id", "g.*")


@query("select nation, count(*) as features, count(*) filter (xmin is null) as missing, count(*) filter (xmin is null) > 0 as refused, case when count(xmin) = 0 then 'no feature has a geometry' when count(*) filter (xmin is null) > 0 then printf('%d features have no geometry', count(*) filter (xmin is null)) end as reason from features group by nation", "features")
def null_geometry_refused(spark, d):
    """What the default policy says of each nation's features, of which some have no geometry; it refuses them together as well."""
    own = views.features(spark, d)
    try:
        spatial.with_null_policy(own)
    except ValueError:
        return spatial.refusals(own, ("nation",))
    raise AssertionError("features without geometry weren't refused")


_CUBES = [(0, -0.05, -0.05, -0.05, 0.05, 0.05, 0.05), (1, 0.0, -1.0, -0.02, 1.0, 1.0, 0.1)]


@query("select q as query, count(*) as n, sum(pid)::bigint as pids from points join (values " + ", ".join(map(str, _CUBES)) + ") b(q, x0, y0, z0, x1, y1, z1) on x between x0 and x1 and y between y0 and y1 and z between z0 and z1 group by q", "points")
def cube_query_points(spark, d):
    return points.in_cube(views.points(spark, d), _CUBES).groupBy("query").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


@query(ORACLE["cube_query_points"])
def octree_box_read(spark, d):
    """The same boxes read from a written octree, by its nodes."""
    path = f"{shared_dir(spark)}/quarry/octree-{uuid.uuid4().hex}"
    points.write_octree(views.points(spark, d), path, span=4)
    return points.octree_boxes(spark, path, _CUBES).groupBy("query").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


@query(None)
def octree_node_table(spark, d):
    """Nodes of a written octree with the boxes about their points."""
    path = f"{shared_dir(spark)}/quarry/octree-{uuid.uuid4().hex}"
    points.write_octree(views.points(spark, d), path, span=4)
    nodes = spark.read.parquet(f"{path}/nodes")
    return nodes.select("depth", F.col("octree_node").alias("node"), F.col("octree_part").alias("part"), "points", *[f"{m}_{c}" for c in "xyz" for m in ("min", "max")])


@query("select pid, x, y, z from points where pid % 5 > 2", "points")
def finite_points(spark, d):
    spoilt = F.when(F.col("pid") % 5 == 0, float("nan")).when(F.col("pid") % 5 == 1, float("inf")).when(F.col("pid") % 5 == 2, None).otherwise(F.col("x"))
    return points.finite(views.points(spark, d).withColumn("x", spoilt)).select("pid", "x", "y", "z")


@query(None)
def pooled_replicates(spark, d):
    """Replicates of all products numbered anew within a condition and metric."""
    merged = measure.merge_workers(views.measurements(spark, d), _KEYS)
    return measure.pool_conditions(merged, ["cache", "concurrency"], "metric", "product", "replicate").select("cache", "concurrency", "metric", "product", "replicate", F.col("pooled_replicate").cast("long"))


ORACLE["pooled_replicates"] = with_views("", "measurements").rstrip() + f", {_MERGED} select cache, concurrency, metric, product, replicate, row_number() over (partition by cache, concurrency, metric order by product, replicate) - 1 as pooled_replicate from merged"


@query("select 'read' as phase, cache, concurrency, replicate, metric, round(avg(value), 6) as value, null::varchar as error from measurements group by all", "measurements")
def condition_assembly(spark, d):
    own = views.measurements(spark, d).withColumns({"phase": F.lit("read"), "error": F.lit(None).cast("string")})
    each = run.assemble_conditions(own).select("phase", "cache", "concurrency", "error", F.explode("replicates").alias("r"))
    flat = each.select("phase", "cache", "concurrency", "error", "r.replicate", F.explode("r.metrics").alias("m"))
    return rounded(flat.select("phase", "cache", "concurrency", "replicate", F.col("m.key").alias("metric"), F.col("m.value").alias("value"), "error"))


@query(None)
def condition_lines(spark, d):
    """Lines of all conditions, from the statistics over their replicates."""
    merged = measure.merge_workers(views.measurements(spark, d), _KEYS)
    figures = measure.replicate_statistics(merged.withColumn("phase", F.lit("read")), ["phase", "cache", "concurrency", "metric"])
    return report.condition_rows(figures).select("line")


ORACLE["condition_lines"] = with_views("", "measurements").rstrip() + f", {_MERGED} select '| read | ' || cache || ' | ' || case concurrency when 1 then 'isolated' else 'concurrent (' || concurrency || ')' end || ' | ' || metric || ' | ' || count(*) || ' | ' || printf('%.6f', round_even(avg(value), 6)) || ' | ' || printf('%.6f', round_even(stddev_pop(value), 6)) || ' |' as line from merged group by cache, concurrency, metric"


@query("select '* ' || doc_id || case when doc_id % 4 = 0 then ': skipped (' || case when doc_id % 8 = 0 then 'no reason given' else lang end || ')' else ': /a/' || source end as line from documents")
def artifact_lines(spark, d):
    n = F.col("doc_id")
    own = views.table(spark, d, "documents").select(n.cast("string").alias("name"), F.when(n % 4 != 0, F.concat(F.lit("/a/"), "source")).alias("uri"), F.when(n % 8 != 0, F.col("lang")).alias("reason"))
    return report.artifact_rows(own).select("line")


@query(ORACLE["bbox_overlap_count"])
def rtree_box_count(spark, d):
    """The same features as by plain comparison, from a written tree whose nodes are descended."""
    path = f"{shared_dir(spark)}/quarry/rtree-{uuid.uuid4().hex}"
    rtree.write_rtree(views.features(spark, d), path, 8, ["id"])
    return rtree.overlapping(spark, path, _BOXES, 8).groupBy("query").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(None)
def rtree_nodes(spark, d):
    """Boxes of all nodes of the packed tree over the features, by curve and id."""
    return rtree.node_table(rtree.in_order(views.features(spark, d), ["id"]))


# A run over a set of products.


def _run_inputs(spark, d):
    """Objects, writes and measurements of the same five products."""
    product = lambda c: (F.col(c) % 5).cast("string")
    objects = views.table(spark, d, "documents").select(product("doc_id").alias("product"), F.col("n_chars").cast("long").alias("size"))
    writes = views.writes(spark, d).withColumn("product", product("container"))
    events = views.measurements(spark, d).withColumns({"product": F.col("product").cast("string"), "phase": F.lit("read"), "component": F.col("replicate") % 2 + F.col("worker"), "error": F.when((F.col("product") == 3) & (F.col("cache") == "cold"), "no such object")})
    return objects, writes, events


@query(None)
def product_run(spark, d):
    """Every figure of a run: profiles, write figures, conditions over the first two components; of each product and over all."""
    got = runs.product_run(*_run_inputs(spark, d), runs.Plan(samples=2, tiers=(("hot", 0), ("warm", 2000), ("cold", 2400))))
    return rounded(runs.figures(got), 8)


@query(None)
def product_run_report(spark, d):
    """Lines of the run's report, of products by prefix and pattern."""
    return runs.summary(runs.product_run(*_run_inputs(spark, d), runs.Plan(pattern="^[0-3]$", metrics=["click", "view"])))


_RUN = with_views("", "measurements", "writes").rstrip() + """, o as (select (doc_id % 5)::varchar as product, n_chars as size from documents where {products}),
w as (select (container % 5)::varchar as product, elapsed, bytes_out, bytes_in from writes where {w_products}),
e as (select product::varchar as product, cache, concurrency, replicate, worker, metric, value, replicate % 2 + worker as component, product = 3 and cache = 'cold' as failed from measurements where {e_products}),
p as (select grouping(product) = 1 as is_rollup, product, count(*) as object_count, sum(size) as total_bytes, avg(size) as mean_bytes, min(size) as min_bytes, max(size) as max_bytes, quantile_cont(size, 0.5) as median_bytes, quantile_cont(size, 0.9) as p90_bytes, quantile_cont(size, 0.95) as p95_bytes, quantile_cont(size, 0.99) as p99_bytes, count(distinct product) as products from o group by grouping sets ((product), ())),
f as (select grouping(product) = 1 as is_rollup, product, sum(elapsed::decimal(28, 9))::double as elapsed, sum(bytes_out::decimal(28, 9))::double as bytes_out, sum(bytes_in::decimal(28, 9))::double as bytes_in, count(*) as components from w group by grouping sets ((product), ())),
m as (select product, cache, concurrency, component, replicate, metric, avg(case when not failed then value end) as value from e where {sample} group by all),
c as (select grouping(product) = 1 as is_rollup, product, cache, concurrency, metric, avg(value) as mean, median(value) as median, stddev_pop(value) as spread, count(value) as replicates from m group by grouping sets ((product, cache, concurrency, metric), (cache, concurrency, metric)))"""
_ANY = {"products": "true", "w_products": "container % 5 in (select distinct doc_id % 5 from documents)", "e_products": "product in (select distinct doc_id % 5 from documents)"}
ORACLE["product_run"] = _RUN.format(sample="component < 2", **_ANY) + (
    " select is_rollup, product, section, name, round(value, 8) as value from ("
    + " union all ".join(f"select is_rollup, product, 'profile' as section, '{c}' as name, {c}::double as value from p" for c in ("object_count", "total_bytes", "mean_bytes", "min_bytes", "max_bytes", "median_bytes", "p90_bytes", "p95_bytes", "p99_bytes"))
    + "".join(f" union all select is_rollup, product, 'write', '{c.split()[-1]}', ({c.split()[0]})::double from f" for c in ("elapsed", "bytes_out", "bytes_in", "components", "bytes_out/elapsed throughput"))
    + " union all select is_rollup, product, 'run', 'products', products from p union all select is_rollup, product, 'run', 'tier:' || case when floor(mean_bytes) >= 2400 then 'cold' when floor(mean_bytes) >= 2000 then 'warm' else 'hot' end, 1 + (floor(mean_bytes) >= 2000)::int + (floor(mean_bytes) >= 2400)::int from p"
    + "".join(f" union all select is_rollup, product, 'condition', 'read/' || cache || '/' || concurrency || '/' || metric || '/{c}', {c}::double from c" for c in ("mean", "median", "spread", "replicates"))
    + ") where value is not null"
)
_SIZE = "case when {n} < 1024 then printf('%d B', ({n})::bigint) when {n} < 1048576 then printf('%.1f KiB', round_even(({n}) / 1024.0, 1)) else printf('%.1f MiB', round_even(({n}) / 1048576.0, 1)) end"
ORACLE["product_run_report"] = _RUN.format(sample="metric in ('click', 'view')", products="doc_id % 5 <= 3", w_products="container % 5 <= 3", e_products="product <= 3") + (
    ", t as (select (3 + row_number() over (order by is_rollup, product))::int as line_no, '| ' || case when is_rollup then '**all products**' else product end || ' | ' || object_count || ' | ' || "
    + " || ' | ' || ".join(_SIZE.format(n=f"trunc({c})::bigint") for c in ("total_bytes", "mean_bytes", "p95_bytes"))
    + " || ' |' as line from p), l as (select (3 + row_number() over (order by cache, concurrency, metric))::int as line_no, '| read | ' || cache || ' | ' || case concurrency when 1 then 'isolated' else 'concurrent (' || concurrency || ')' end || ' | ' || metric || ' | ' || replicates || ' | ' || printf('%.6f', round_even(mean, 6)) || ' | ' || printf('%.6f', round_even(spread, 6)) || ' |' as line from c where is_rollup and replicates > 0) "
    "select 0 as part, line_no, line from t union all select 0, i, v from (values (0, '## Products'), (1, ''), (2, '| product | objects | total | mean | p95 |'), (3, '| --- | --- | --- | --- | --- |')) h(i, v) union all select 1, line_no, line from l union all select 1, i, v from (values (0, '## Conditions over all products'), (1, ''), (2, '| phase | cache | run | metric | replicates | mean | spread |'), (3, '| --- | --- | --- | --- | --- | --- | --- |')) h(i, v) union all select 2, i, v from (values (0, '## Skipped'), (1, ''), (2, '| phase | cache | concurrency | reason |'), (3, '| --- | --- | --- | --- |')) h(i, v)"
)


# SQL for queries whose place is elsewhere.

_SHOWN = "case when {n} < 1024 then printf('%d B', ({n})::bigint) when {n} < 1048576 then printf('%.1f KiB', round_even(({n}) / 1024.0, 1)) when {n} < 1073741824 then printf('%.1f MiB', round_even(({n}) / 1048576.0, 1)) else printf('%.1f GiB', round_even(({n}) / 1073741824.0, 1)) end"
ORACLE["markdown_summary"] = (
    "with p as (" + ORACLE["product_rollup"] + "), t as (select is_rollup, product, '| ' || case when is_rollup then '**all products**' else product end || ' | ' || object_count || ' | ' || "
    + " || ' | ' || ".join(_SHOWN.format(n=f"trunc({c})::bigint") for c in ("total_bytes", "mean_bytes", "p95_bytes"))
    + " || ' |' as line from p) select 0 as line_no, '## Products' as line union all select 1, '' union all select 2, '| product | objects | total | mean | p95 |' union all select 3, '| --- | --- | --- | --- | --- |' union all select (3 + row_number() over (order by is_rollup, product))::int, line from t"
)

_TURN = "select id, case when ry = 1 then px when rx = 1 then s - 1 - py else py end as x, case when ry = 1 then py when rx = 1 then s - 1 - px else px end as y, s // 2 as s, d + s * s * xor(3 * rx, ry) as d from (select id, s, d, (x & s > 0)::bigint as rx, (y & s > 0)::bigint as ry, x & (s - 1) as px, y & (s - 1) as py from {source} where s > 0)"
ORACLE["hilbert_order"] = (
    with_views("", "features").rstrip().replace("with ", "with recursive ", 1)
    + ", e as (select min(xmin) as x0, min(ymin) as y0, max(xmax) as x1, max(ymax) as y1 from features), r(id, x, y, s, d) as (select id, least(greatest(floor(((xmin + xmax) / 2 - x0) / (x1 - x0) * 65535), 0), 65535)::bigint, least(greatest(floor(((ymin + ymax) / 2 - y0) / (y1 - y0) * 65535), 0), 65535)::bigint, 32768::bigint, 0::bigint from features, e where xmin is not null union all "
    + _TURN.format(source="r")
    + ") select id, d as curve from r where s = 0"
)
ORACLE["rtree_nodes"] = (
    f"with recursive placed as (select row_number() over (order by curve, id) - 1 as n, f.xmin, f.ymin, f.xmax, f.ymax from ({ORACLE['hilbert_order']}) h join ({SQL['features']}) f using (id)), total as (select count(*) as n from placed), "
    "depth(level, nodes) as (select 0, ceil(n / 16.0)::bigint from total where n > 0 union all select level + 1, ceil(nodes / 16.0)::bigint from depth where nodes > 1) "
    "select level, (n // (16 ** (level + 1))::bigint)::bigint as node, case level when 0 then count(*) else count(distinct n // (16 ** level)::bigint) end as children, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from placed, depth group by level, n // (16 ** (level + 1))::bigint"
)

_CELL = "least(floor((x - (x0 + nx * s)) / s * 4), 3) as cx, least(floor((y - (y0 + ny * s)) / s * 4), 3) as cy, least(floor((z - (z0 + nz * s)) / s * 4), 3) as cz"
_MARK = "depth = 21 or count(*) over (partition by nx, ny, nz) <= 64 or row_number() over (partition by nx, ny, nz, cx, cy, cz order by pid) = 1 as kept"
ORACLE["octree_nodes"] = (
    with_views("", "points").rstrip().replace("with ", "with recursive ", 1)
    + f", e as (select min(x) as x0, min(y) as y0, min(z) as z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as s from points), r as (select *, {_MARK} from (select *, {_CELL} from (select 0 as depth, pid, x, y, z, x0, y0, z0, s, 0::bigint as nx, 0::bigint as ny, 0::bigint as nz from points, e)) union all select *, {_MARK} from (select *, {_CELL} from (select depth + 1 as depth, pid, x, y, z, x0, y0, z0, s / 2 as s, 2 * nx + (x >= x0 + nx * s + s / 2)::bigint as nx, 2 * ny + (y >= y0 + ny * s + s / 2)::bigint as ny, 2 * nz + (z >= z0 + nz * s + s / 2)::bigint as nz from r where not kept))) select pid, depth, concat_ws('-', depth, nx, ny, nz) as node from r where kept"
)
ORACLE["octree_node_counts"] = f"select depth, count(*) as nodes, sum(n)::bigint as points, max(n) as max_node_points from (select depth, node, count(*) as n from ({ORACLE['octree_nodes']}) group by depth, node) group by depth"
_ANCESTOR = "(split_part(node, '-', {k})::bigint >> greatest(depth - 2, 0))"
ORACLE["octree_node_table"] = f"with n as ({ORACLE['octree_nodes']}) select depth, node, (depth * 100 + ({_ANCESTOR.format(k=2)} * 4 + {_ANCESTOR.format(k=3)}) * 4 + {_ANCESTOR.format(k=4)})::int as part, count(*) as points, min(embedding[1])::double as min_x, max(embedding[1])::double as max_x, min(embedding[2])::double as min_y, max(embedding[2])::double as max_y, min(embedding[3])::double as min_z, max(embedding[3])::double as max_z from n join embeddings on pid = vec_id group by depth, node"
