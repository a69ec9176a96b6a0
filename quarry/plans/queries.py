"""Queries over whole tables, one for each operator, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import grid, uri
from quarry.operators import catalog, measure, points, profile, raster, report, spatial, tiles
from quarry.plans import views
from quarry.plans.views import FILL, SIDE, with_views
from quarry.sources import listing

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a query under its function's name, with SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns rounded, for comparison."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_STATS = "count(*)::bigint as object_count, sum(size)::bigint as total_bytes, round(avg(size), 4) as mean_bytes, min(size)::bigint as min_bytes, max(size)::bigint as max_bytes, round(quantile_cont(size, 0.5), 4) as median_bytes, round(quantile_cont(size, 0.5), 4) as p50_bytes, round(quantile_cont(size, 0.9), 4) as p90_bytes, round(quantile_cont(size, 0.95), 4) as p95_bytes, round(quantile_cont(size, 0.99), 4) as p99_bytes"


@query(f"select {_STATS} from objects", "objects")
def size_profile(spark, d):
    return rounded(profile.size_profile(views.objects(spark, d)), 4)


@query(f"select grouping(product) = 1 as is_rollup, product, {_STATS} from objects group by grouping sets ((product), ())", "objects")
def product_rollup(spark, d):
    return rounded(profile.size_profile(views.objects(spark, d), ["product"], rollup=True), 4)


@query(
    "select bin::int as bin, (2 ** (lo + bin))::bigint as low, (2 ** (lo + bin + 1))::bigint as high, count(size)::bigint as n from (select floor(log2(greatest(min(size), 1)))::int as lo, floor(log2(greatest(max(size), 1)))::int as hi from objects) cross join lateral (select unnest(range(hi - lo + 1)) as bin) left join objects on floor(log2(greatest(size, 1)))::int = lo + bin group by bin, lo",
    "objects",
)
def size_histogram(spark, d):
    return profile.histogram(views.objects(spark, d))


_EDGES = [100, 500, 1000, 2000, 5000]


@query(
    "select bin::int as bin, [100,500,1000,2000,5000][bin + 1]::bigint as low, [100,500,1000,2000,5000][bin + 2]::bigint as high, count(size)::bigint as n from (select unnest([0,1,2,3]) as bin) left join (select size, least(greatest(len(list_filter([100,500,1000,2000,5000], lambda e: e <= size)) - 1, 0), 3) as b from objects) on b = bin group by bin",
    "objects",
)
def size_histogram_custom_edges(spark, d):
    return profile.histogram(views.objects(spark, d), _EDGES)


_TIERS = (("hot", 0), ("warm", 2000), ("cold", 2400))


@query("select product, array_to_string(list_filter([case when floor(m) >= 0 then 'hot' end, case when floor(m) >= 2000 then 'warm' end, case when floor(m) >= 2400 then 'cold' end], lambda x: x is not null), ',') as tiers, case when floor(m) >= 2400 then 'cold' when floor(m) >= 2000 then 'warm' else 'hot' end as highest from (select product, avg(size) as m from objects group by product)", "objects")
def tier_fitness(spark, d):
    means = profile.size_profile(views.objects(spark, d), ["product"])
    return means.select("product", F.array_join(profile.tiers_fit(F.col("mean_bytes"), _TIERS), ",").alias("tiers"), profile.highest_tier(F.col("mean_bytes"), _TIERS).alias("highest"))


def _layouts(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("raster", "columnar", "indexed", "octree", "store")])
    return views.table(spark, d, "part").select("p_brand", kinds[(F.col("p_partkey") % 5).cast("int")].alias("kind"), (F.col("p_size") > 25).alias("tiled"), (F.col("p_size") % 2 == 0).alias("indexed"), F.col("p_size").cast("long").alias("parts"))


@query("select p_brand, count(*) filter (k = 0) as rasters, count(*) filter (k = 0 and p_size > 25) as tiled, coalesce(sum(p_size) filter (k = 1), 0)::bigint as row_groups, count(*) filter (k = 2 and p_size % 2 = 0) as with_index, coalesce(sum(p_size) filter (k = 3), 0)::bigint as nodes, coalesce(sum(p_size) filter (k = 4), 0)::bigint as shards from (select *, p_partkey % 5 as k from part) group by p_brand")
def layout_digest(spark, d):
    return profile.layout_digest(_layouts(spark, d), ["p_brand"])


@query("select key, size from objects where (key = 'src1' or key like 'src1/%') and key like '%1' and regexp_matches(key, 'en|de') order by key limit 25", "objects")
def catalog_filter_limit(spark, d):
    return listing.select_objects(views.objects(spark, d), "src1", "1", "en|de", 25).select("key", "size")


@query(r"select page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') as id from pages where regexp_matches(url, '^https?://(www|blog)\.')")
def catalog_regex_select(spark, d):
    pages = views.table(spark, d, "pages").where(F.regexp_like("url", F.lit(r"^https?://(www|blog)\.")))
    return pages.select("page_id", F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).alias("id"))


@query(
    r"""select doc_id, source as bucket, lang || '/' || doc_id || '.tif' as object_key, '/vsis3/' || source || '/' || lang || '/' || doc_id || '.tif' as path, '/data/' || source || '.zip' as archive, doc_id::varchar || '.tif' as name, '.tif' as ext from documents"""
)
def uri_parse(spark, d):
    at = F.concat(F.lit("s3://"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".tif"))
    inside = F.concat(F.lit("/vsizip//data/"), "source", F.lit(".zip/"), "doc_id", F.lit(".tif"))
    return views.table(spark, d, "documents").select("doc_id", uri.bucket(at).alias("bucket"), uri.key(at).alias("object_key"), uri.reader_path(at).alias("path"), uri.zip_container(inside).alias("archive"), uri.base_name(at).alias("name"), uri.extension(at).alias("ext"))


@query("select doc_id, n_chars * 37 as n, case when n_chars * 37 < 1024 then printf('%d B', n_chars * 37) when n_chars * 37 < 1048576 then printf('%.1f KiB', n_chars * 37 / 1024.0) else printf('%.1f MiB', n_chars * 37 / 1048576.0) end as shown from documents")
def summary_bytes_format(spark, d):
    n = F.col("n_chars") * 37
    return views.table(spark, d, "documents").select("doc_id", n.alias("n"), uri.format_bytes(n).alias("shown"))


@query("select product, component, row_number() over (partition by product order by component = 'en', component) as place from (select distinct product, component from objects)", "objects")
def component_order(spark, d):
    own = views.objects(spark, d).select("product", "component").distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy("product").orderBy(F.col("component") == "en", "component")))


@query("select product, component, case when component in ('de', 'fr') then 'pair' end as bundle from (select distinct product, component from objects)", "objects")
def bundle_groups_singles(spark, d):
    own = views.objects(spark, d).select("product", "component").distinct()
    return catalog.bundles(own, {"pair": ["de", "fr"], "alone": ["en"]})


@query("select product, composite from (select product, list(distinct component) as have from objects group by product) cross join (values ('near', ['en', 'de']), ('far', ['es', 'fr', 'de'])) c(composite, bands) where list_has_all(have, bands)", "objects")
def composite_realizable(spark, d):
    return catalog.realisable(views.objects(spark, d), {"near": ["en", "de"], "far": ["es", "fr", "de"]})


@query("select product, arg_min(o_custkey, k) as container, arg_min(o_totalprice, k) as charged_bytes from (select o_orderstatus as product, o_custkey, o_totalprice, o_orderkey as k from orders) group by product")
def container_charge_once(spark, d):
    own = views.table(spark, d, "orders").select(F.col("o_orderstatus").alias("product"), F.col("o_custkey").alias("container"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return measure.charge_once(own, "product", "container", "o_orderkey", "price")


@query("select product, key, size, place from (select *, row_number() over (partition by product order by component = 'en', key) as place from objects) where place <= 3", "objects")
def sample_first_n(spark, d):
    own = views.objects(spark, d).withColumn("late", F.col("component") == "en")
    return measure.first_n(own, 3, "product", "late", "key").select("product", "key", "size", F.col("place").cast("long"))


@query("select *, bytes_out / elapsed as throughput from (select product, container, sum(elapsed::decimal(28, 9))::double as elapsed, sum(bytes_out::decimal(28, 9))::double as bytes_out, sum(bytes_in::decimal(28, 9))::double as bytes_in, count(*) as components from writes group by product, container)", "writes")
def write_rollup(spark, d):
    return measure.write_rollup(views.writes(spark, d), ["product", "container"])


_KEYS = ["product", "cache", "concurrency", "replicate", "metric"]
_MERGED = "merged as (select product, cache, concurrency, replicate, metric, avg(value) as value, count(*) as workers from measurements group by all)"


@query("select product, cache, concurrency, replicate, metric, round(avg(value), 6) as value, count(*) as workers from measurements group by all", "measurements")
def worker_merge(spark, d):
    return rounded(measure.merge_workers(views.measurements(spark, d), _KEYS))


_OF = "round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as spread, count(*) as replicates"


@query(None)
def replicate_aggregate(spark, d):
    merged = measure.merge_workers(views.measurements(spark, d), _KEYS)
    return rounded(measure.replicate_statistics(merged, ["product", "cache", "concurrency", "metric"]))


ORACLE["replicate_aggregate"] = with_views("", "measurements").rstrip() + f", {_MERGED} select product, cache, concurrency, metric, {_OF} from merged group by all"


@query(None)
def condition_pool(spark, d):
    merged = measure.merge_workers(views.measurements(spark, d), _KEYS)
    pooled = measure.pool_conditions(merged, ["cache", "concurrency"], "metric", "product", "replicate")
    return rounded(pooled.groupBy("cache", "concurrency", "metric").agg(F.max("pooled_replicate").cast("long").alias("last"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("spread")))


ORACLE["condition_pool"] = with_views("", "measurements").rstrip() + f", {_MERGED} select cache, concurrency, metric, count(*) - 1 as last, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as spread from merged group by all"


@query("select l_returnflag, count(*) as reads, round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as p50, round(stddev_pop(l_quantity), 6) as spread, round(sum(l_extendedprice) / sum(l_quantity), 6) as throughput from lineitem group by l_returnflag")
def read_latency_summary(spark, d):
    return rounded(measure.latency_summary(views.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("select p_size, p_brand, min(p_partkey) as first, count(*) as members, 'grid' || (dense_rank() over (order by min(p_partkey)) - 1) as grid from part group by p_size, p_brand")
def grid_grouping(spark, d):
    return raster.group_grids(views.table(spark, d, "part"), "p_size", "p_brand", order="p_partkey")


_BOXES = [(k, 5.0 * k, 1.0 * k, 5.0 * k + 7.3, 1.0 * k + 9.0) for k in range(8)]
_BOX_SQL = "boxes(query, qx0, qy0, qx1, qy1) as (values " + ", ".join(str(b) for b in _BOXES) + ")"


@query(None)
def bbox_overlap_count(spark, d):
    return spatial.overlapping(views.features(spark, d), _BOXES).groupBy("query").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


ORACLE["bbox_overlap_count"] = with_views("", "features").rstrip() + f", {_BOX_SQL} select query, count(*) as n, sum(id)::bigint as ids from features join boxes on xmin <= qx1 and xmax >= qx0 and ymin <= qy1 and ymax >= qy0 group by query"


@query("select id, xmin, ymin, xmax, ymax from features where xmin is not null", "features")
def null_geometry_drop(spark, d):
    return spatial.drop_null(views.features(spark, d)).select("id", *spatial.BOX)


@query("select id, xmin is null as null_geometry, coalesce(xmin, lon) as xmin, coalesce(ymin, lat) as ymin, coalesce(xmax, lon) as xmax, coalesce(ymax, lat) as ymax from features", "features")
def null_geometry_point_from(spark, d):
    return spatial.point_from(views.features(spark, d), "lon", "lat").select("id", "null_geometry", *spatial.BOX)


@query("select id, xmin is null as null_geometry, round(coalesce(xmin, e.x0 - 0.01 * (e.x1 - e.x0) - 1), 6) as xmin, round(coalesce(ymin, e.y0 - 0.01 * (e.y1 - e.y0) - 1), 6) as ymin from features cross join (select min(xmin) as x0, min(ymin) as y0, max(xmax) as x1, max(ymax) as y1 from features) e", "features")
def null_geometry_sentinel(spark, d):
    return rounded(spatial.sentinel(views.features(spark, d)).select("id", "null_geometry", "xmin", "ymin"))


@query("select nation, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from features group by nation", "features")
def feature_extent(spark, d):
    return spatial.extent(views.features(spark, d), ("nation",))


@query("select nation, row_group, count(*) as n, min(id) as first_id from (select nation, id, (row_number() over (partition by nation order by lat, lon) - 1) // 7 as row_group from features) group by nation, row_group", "features")
def row_group_assign(spark, d):
    return spatial.row_groups(views.features(spark, d), 7, "nation", "lat", "lon").groupBy("nation", "row_group").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("with recursive n as (select o_custkey, count(*) as f from orders group by 1), l(o_custkey, f, k) as (select o_custkey, f, f from n union all select o_custkey, f, ceil(k / 4.0)::bigint from l where k > 1) select o_custkey, f as features, ((sum(k) + case when f = 1 then 1 else 0 end) * 40)::bigint as index_bytes from l group by o_custkey, f")
def rtree_index_bytes(spark, d):
    n = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("features"))
    return n.withColumn("index_bytes", grid.index_bytes(F.col("features"), F.lit(4)))


@query(None)
def hilbert_order(spark, d):
    """Features with their place on the curve; tested for being one-to-one and local."""
    return spatial.with_curve(spatial.drop_null(views.features(spark, d))).select("id", "curve")


_WINDOWS = [(k, 7 * k, 5 * k, 16, 16) for k in range(8)]


@query(None)
def window_read(spark, d):
    return rounded(raster.window_reads(views.cells(spark, d), _WINDOWS).groupBy("window").agg(F.count("*").alias("cells"), F.sum("value").alias("total")))


ORACLE["window_read"] = with_views("", "cells").rstrip() + ', w(wid, r, c) as (values ' + ", ".join(f"({k}, {r}, {c})" for k, r, c, _, _ in _WINDOWS) + ') select wid as "window", count(*) as cells, round(sum(value), 6) as total from cells join w on "row" >= r and "row" < r + 16 and col >= c and col < c + 16 group by wid'


@query('select "row" // 2 as "row", col // 2 as col, round(avg(value), 6) as value from cells group by 1, 2', "cells")
def block_mean_level1(spark, d):
    return rounded(raster.block_mean(views.cells(spark, d), 2, SIDE, SIDE))


@query(f'select "row" // 3 as "row", col // 3 as col, trunc(coalesce(avg(case when value <> {FILL} then round_even(value, 0) end), {FILL})) as value from cells where "row" < 63 and col < 63 group by 1, 2', "cells")
def block_mean_fill_aware(spark, d):
    whole = views.cells(spark, d).withColumn("value", F.rint("value"))
    return raster.block_mean(whole, 3, SIDE, SIDE, FILL, integer=True)


_MEAN = f"coalesce(avg(case when value <> {FILL} then value end), {FILL})"


@query(None)
def pyramid_levels(spark, d):
    return rounded(raster.pyramid(views.cells(spark, d), SIDE, SIDE, [2, 2, 4], FILL).where("level > 0"))


ORACLE["pyramid_levels"] = with_views("", "cells").rstrip() + f', a as (select "row" // 2 as "row", col // 2 as col, {_MEAN} as value from cells group by 1, 2), b as (select "row" // 2 as "row", col // 2 as col, {_MEAN} as value from a group by 1, 2), c as (select "row" // 4 as "row", col // 4 as col, {_MEAN} as value from b group by 1, 2) select 1 as level, "row", col, round(value, 6) as value from a union all select 2, "row", col, round(value, 6) from b union all select 3, "row", col, round(value, 6) from c'


@query('select "row", col, max(value) filter (band = \'A\') as "A", max(value) filter (band = \'N\') as "N", max(value) filter (band = \'R\') as "R" from band_cells group by 1, 2', "band_cells")
def band_stack_pivot(spark, d):
    return raster.stack(views.cells(spark, d, "l_returnflag"), ["A", "N", "R"])


@query(f'select "row", col, arg_max(value, band) as value from band_cells where value <> {FILL} group by 1, 2', "band_cells")
def mosaic_last_wins(spark, d):
    return raster.mosaic(views.cells(spark, d, "l_returnflag").withColumnRenamed("band", "ordinal"), FILL)


@query('select l_orderkey, l_linenumber, round_even((l_extendedprice - 100) / 0.5, 0)::int as packed, round_even((l_extendedprice - 100) / 0.5, 0)::int * 0.5::double + 100 as unpacked from lineitem')
def scale_offset_decode(spark, d):
    packed = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raster.pack(F.col("l_extendedprice"), 0.5, 100.0).alias("packed"))
    return packed.withColumn("unpacked", raster.unpack(F.col("packed"), 0.5, 100.0))


@query(f'select cr // 2 as shard_row, cc // 2 as shard_col, count(*) as chunks, count(*) * 128 as size from (select "row" // 4 as cr, col // 4 as cc from cells group by 1, 2 having count(*) filter (value <> {FILL}) > 0) group by 1, 2', "cells")
def shard_object_sizes(spark, d):
    return raster.shard_objects(views.cells(spark, d), 4, 2, 8, FILL)


_DECIMATIONS = [1, 2, 4, 8, 16]


@query("select p_partkey, p_size, coalesce(max(d) filter (d <= p_size / 3.0), 1)::int as decimation from part cross join (values (1), (2), (4), (8), (16)) l(d) group by p_partkey, p_size")
def level_pick_asof(spark, d):
    return views.table(spark, d, "part").select("p_partkey", "p_size", tiles.pick_decimation(_DECIMATIONS, F.lit(3.0), F.col("p_size").cast("double")).alias("decimation"))


@query(None)
def voxel_representatives(spark, d):
    return points.voxel_representatives(views.points(spark, d), 8)


ORACLE["voxel_representatives"] = with_views("", "points").rstrip() + ", e as (select min(x) as x0, min(y) as y0, min(z) as z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as s from points) select ((least(floor((x - x0) / s * 8), 7) * 8 + least(floor((y - y0) / s * 8), 7)) * 8 + least(floor((z - z0) / s * 8), 7))::bigint as cell, min(pid) as pid from points, e group by 1"


@query(None)
def octree_nodes(spark, d):
    """Nodes of all points; tested against a recursive construction."""
    from quarry.plans.tables import written

    return points.octree(views.points(spark, d), span=4, checkpoint=written)


@query(None)
def octree_node_counts(spark, d):
    return points.node_layout(octree_nodes(spark, d))


_CUBES = [(0, -0.05, -0.05, 0.05, 0.05), (1, 0.0, -1.0, 1.0, 1.0)]


@query("select q as query, count(*) as n, sum(pid)::bigint as pids from points join (values (0, -0.05, -0.05, 0.05, 0.05), (1, 0.0, -1.0, 1.0, 1.0)) b(q, x0, y0, x1, y1) on x between x0 and x1 and y between y0 and y1 group by q", "points")
def box_query_points(spark, d):
    return points.in_box(views.points(spark, d), _CUBES).groupBy("query").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


@query(None)
def markdown_summary(spark, d):
    """Lines of the product report in order."""
    return report.markdown(report.product_rows(product_rollup(spark, d)), "Products", ["product", "objects", "total", "mean", "p95"])
