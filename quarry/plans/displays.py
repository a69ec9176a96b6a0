"""Queries about display tiles of a table of grids, each supplier one (turned, sheared, and some in degrees), and about layout records of parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import quarry.sources.stored  # noqa: F401  layouts register there
from quarry.operators import layouts, tiles
from quarry.plans import products, views  # noqa: F401  their SQL is used here
from quarry.plans.queries import ORACLE, query
from quarry.plans.tables import shared_dir
from quarry.plans.views import with_views
from quarry.sources.options import options_of
from quarry.sources.registry import layouts as kinds


def grids(spark, d):
    """North-up grids in metres, and of every three one that is turned and sheared and one in degrees."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 3
    left, top = ((k * 7919) % 20000 - 10000) * 1000.0, ((k * 104729) % 20000 - 10000) * 800.0
    metres = lambda b, dd: F.array(F.lit(100.0), F.lit(b), left, F.lit(dd), F.lit(-100.0), top)
    degrees = F.array(F.lit(0.001), F.lit(0.0), ((k * 7919) % 300 - 150) * 1.0, F.lit(0.0), F.lit(-0.001), ((k * 104729) % 120 - 50) * 1.0)
    affine = F.when(kind == 0, metres(0.0, 0.0)).when(kind == 1, metres(30.0, -20.0)).otherwise(degrees)
    some = F.when(F.col("s_nationkey") % 2 == 0, F.array(*[F.lit(x) for x in (1, 2, 4, 8)])).otherwise(F.array(*[F.lit(x) for x in (1, 3, 9)]))
    return views.table(spark, d, "supplier").select(k.alias("grid"), affine.alias("affine"), (2000 + F.col("s_nationkey") * 100).cast("long").alias("rows"), (3000 + F.col("s_nationkey") * 50).cast("long").alias("cols"), F.lit(256).alias("block_rows"), F.lit(512).alias("block_cols"), some.alias("decimations"), F.when(kind == 2, "EPSG:4326").otherwise("EPSG:3857").alias("crs"))


_W = "(pi() * 6378137.0)"
_RES = "(2 * " + _W + " / 256 / 2.0 ** {z})"
_NEAR = "(abs({r} - " + _RES + ") / " + _RES + " <= 1e-8)"


def _zoom(res: str) -> str:
    first = f"coalesce(list_min(list_filter(range(25), lambda z: {res} > {_RES.format(z='z')} or {_NEAR.format(r=res, z='z')})), 24)"
    return f"(select case when f > 0 and not {_NEAR.format(r=res, z='f')} and {_RES.format(z='(f - 1)')} / {res} < {res} / {_RES.format(z='f')} then f - 1 else f end from (select {first} as f))"


_GRIDS = f"""with recursive raw as (select s_suppkey as grid, s_suppkey % 3 as kind, ((s_suppkey * 7919) % 20000 - 10000) * 1000.0::double as px, ((s_suppkey * 104729) % 20000 - 10000) * 800.0::double as py, ((s_suppkey * 7919) % 300 - 150)::double as dx, ((s_suppkey * 104729) % 120 - 50)::double as dy, (2000 + s_nationkey * 100)::double as h, (3000 + s_nationkey * 50)::double as w, case when s_nationkey % 2 = 0 then [1, 2, 4, 8] else [1, 3, 9] end as decimations from supplier),
affine as (select *, case when kind = 2 then 0.001::double else 100.0::double end as a, case when kind = 1 then 30.0::double else 0.0::double end as b, case when kind = 2 then dx else px end as c, case when kind = 1 then -20.0::double else 0.0::double end as d, case when kind = 2 then -0.001::double else -100.0::double end as e, case when kind = 2 then dy else py end as f from raw),
corner as (select *, [c, c + a * w, c + b * h, c + a * w + b * h] as xs, [f, f + d * w, f + e * h, f + d * w + e * h] as ys from affine),
box as (select *, case when kind = 2 then radians(list_min(xs)) * 6378137.0 else list_min(xs) end as x0, case when kind = 2 then radians(list_max(xs)) * 6378137.0 else list_max(xs) end as x1, case when kind = 2 then ln(tan(pi() / 4 + radians(greatest(-85.0511287798066, least(85.0511287798066, list_min(ys)))) / 2)) * 6378137.0 else list_min(ys) end as y0, case when kind = 2 then ln(tan(pi() / 4 + radians(greatest(-85.0511287798066, least(85.0511287798066, list_max(ys)))) / 2)) * 6378137.0 else list_max(ys) end as y1 from corner),
located as (select *, (x1 - x0) / w as metres, {_zoom("((x1 - x0) / w)")}::int as zoom from box)"""

#: Tiles (z, x, y) of rows that have a zoom z, with their windows; then the chunks at a decimation.
_TILES = f"""tile as (select * from (select *, 2 * {_W} / 2.0 ** z as side from {{of}}), unnest(range(greatest(0, least(2 ** z - 1, floor((x0 + {_W}) / side)))::bigint, greatest(0, least(2 ** z - 1, floor((x1 + {_W}) / side)))::bigint + 1)) u(x), unnest(range(greatest(0, least(2 ** z - 1, floor(({_W} - y1) / side)))::bigint, greatest(0, least(2 ** z - 1, floor(({_W} - y0) / side)))::bigint + 1)) v(y)),"""
_WINDOW = f"""tb as (select *, x * side - {_W} as tx0, (x + 1) * side - {_W} as tx1, {_W} - (y + 1) * side as ty0, {_W} - y * side as ty1 from tile),
tc as (select *, [case when kind = 2 then degrees(tx0 / 6378137.0) else tx0 end - c, case when kind = 2 then degrees(tx1 / 6378137.0) else tx1 end - c] as us, [case when kind = 2 then degrees(2 * atan(exp(ty0 / 6378137.0)) - pi() / 2) else ty0 end - f, case when kind = 2 then degrees(2 * atan(exp(ty1 / 6378137.0)) - pi() / 2) else ty1 end - f] as vs, a * e - b * d as area from tb),
tw as (select *, [(e * us[1] - b * vs[1]) / area, (e * us[1] - b * vs[2]) / area, (e * us[2] - b * vs[1]) / area, (e * us[2] - b * vs[2]) / area] as cs, [(a * vs[1] - d * us[1]) / area, (a * vs[2] - d * us[1]) / area, (a * vs[1] - d * us[2]) / area, (a * vs[2] - d * us[2]) / area] as rs from tc),
win as (select *, greatest(list_min(cs), 0.0) as c0, least(list_max(cs), w) as c1, greatest(list_min(rs), 0.0) as r0, least(list_max(rs), h) as r1, list_min(cs) >= -0.5 and list_max(cs) <= w + 0.5 and list_min(rs) >= -0.5 and list_max(rs) <= h + 0.5 as interior, {{decimation}}::int as decimation from tw),
seen as (select *, case when c1 > c0 and r1 > r0 then (greatest(1, floor((c1 / decimation - 1e-9) / 512) - floor(c0 / decimation / 512) + 1) * greatest(1, floor((r1 / decimation - 1e-9) / 256) - floor(r0 / decimation / 256) + 1))::bigint else 0 end as chunks from win)"""
_PICK = "coalesce(list_max(list_filter(decimations, lambda k: {native} * k <= {wanted})), list_min(decimations))"
_AT_ZOOM = _WINDOW.format(decimation=_PICK.format(native="metres", wanted=_RES.format(z="z")))


@query(f"{_GRIDS}, zoomed as (select *, zoom as z from located), {_TILES.format(of='zoomed')} {_AT_ZOOM} select grid, z, x, y, decimation, interior, chunks from seen where c1 > c0 and r1 > r0")
def tile_chunk_count(spark, d):
    """Chunks that each tile of each grid's own zoom touches."""
    return tiles.zoom_tiles(grids(spark, d), F.array("native_zoom"))


_BUCKETS = f"""{_GRIDS}, zoomed as (select *, unnest(range(greatest(0, zoom - len(decimations) - 4), zoom + 1))::int as z from located), {_TILES.format(of='zoomed')} {_AT_ZOOM},
hit as (select * from seen where c1 > c0 and r1 > r0), goal(target) as (values (1), (2), (4), (9)),
met as (select grid, target, max(z) as z from hit join goal on chunks = target or target >= 9 and chunks >= target group by all),
stop as (select grid, case when count(*) = 4 then min(z) else 0 end as stop from met group by grid),
best as (select grid, chunks, arg_min(struct_pack(z := z, x := x, y := y, interior := interior), row(not interior, -z, x, y)) as t from hit join stop using (grid) where z >= stop group by grid, chunks),
bucket as (select grid, target, min(chunks) as chunks from best join goal on chunks = target or target >= 9 and chunks >= target group by all)
"""


@query(f"{_BUCKETS} select grid, target, chunks, t.z as z, t.x as x, t.y as y, t.interior as interior, chunks <> target as approximate from bucket join best using (grid, chunks)")
def tile_buckets(spark, d):
    """The best tile of each grid for 1, 2, 4 and 9 chunks."""
    return tiles.chunk_tiles(grids(spark, d))


_LEVELS = f"{_GRIDS}, zoomed as (select *, {_zoom('(wanted * metres / a)')}::int as z from (select *, a * unnest(decimations) as wanted from located)), {_TILES.format(of='zoomed')} {_WINDOW.format(decimation=_PICK.format(native='a', wanted='wanted'))}"


@query(f"{_LEVELS} select grid, wanted, decimation, z, t.x as x, t.y as y, t.interior as interior, t.chunks as chunks from (select grid, wanted, decimation, z, arg_min(struct_pack(x := x, y := y, interior := interior, chunks := chunks), row(not interior, x, y)) as t from seen where c1 > c0 and r1 > r0 group by all)")
def tile_resolutions(spark, d):
    """A tile for the resolution of each level of each grid."""
    return tiles.resolution_tiles(grids(spark, d))


_LOOK = f"""{_GRIDS}, mid as (select *, greatest(0, zoom - 3) as start, radians((degrees(x0 / 6378137.0) + degrees(x1 / 6378137.0)) / 2) * 6378137.0 + {_W} as u, {_W} - ln(tan(pi() / 4 + radians((degrees(2 * atan(exp(y0 / 6378137.0)) - pi() / 2) + degrees(2 * atan(exp(y1 / 6378137.0)) - pi() / 2)) / 2) / 2)) * 6378137.0 as v from located),
deep as (select *, least(24, start + 3) as deep, floor(u / (2 * {_W} / 2.0 ** least(24, start + 3)))::bigint as dx0, floor(v / (2 * {_W} / 2.0 ** least(24, start + 3)))::bigint as dy0 from mid),
went as (select * exclude (k), k as step, 'start' as action, start as z, floor(u / (2 * {_W} / 2.0 ** start))::bigint as x, floor(v / (2 * {_W} / 2.0 ** start))::bigint as y from deep, (values (0)) q(k)
union all select * exclude (k), k, 'zoom_in', start + k, floor(u / (2 * {_W} / 2.0 ** (start + k)))::bigint, floor(v / (2 * {_W} / 2.0 ** (start + k)))::bigint from deep, (values (1), (2), (3)) q(k)
union all select * exclude (k, p, i, j), k, p, deep, dx0 + i, dy0 + j from deep, (values (4, 'pan_e', 1, 0), (5, 'pan_s', 1, 1), (6, 'pan_w', 0, 1), (7, 'pan_n', 0, 0)) q(k, p, i, j)
union all select * exclude (k), 7 + k, 'zoom_out', deep - k, dx0 >> k, dy0 >> k from deep, (values (1), (2)) q(k) where k <= deep),
tile as (select *, 2 * {_W} / 2.0 ** z as side from went), {_WINDOW.format(decimation=_PICK.format(native='a', wanted=_RES.format(z='z')))}"""


@query(f"{_LOOK} select grid, step, action, z::int as z, x, y, decimation, chunks from seen")
def pan_zoom_session(spark, d):
    """A look at each grid, with the chunks of each step."""
    return tiles.sessions(grids(spark, d))


_ALL = " union all ".join(
    (
        f"select grid, target || 'chunk' as label, t.z as z, t.x as x, t.y as y, chunks, chunks <> target as approximate, null::int as decimation from ({_BUCKETS} select * from bucket join best using (grid, chunks))",
        f"select grid, label, z, t.x, t.y, t.chunks, false, decimation from ({_LEVELS} select grid, 'res_' || regexp_replace(printf('%.6f', wanted), '\\.?0+$', '') || 'm' as label, decimation, z, arg_min(struct_pack(x := x, y := y, chunks := chunks), row(not interior, x, y)) as t from seen where c1 > c0 and r1 > r0 group by grid, wanted, decimation, z)",
        f"select grid, printf('pan_zoom_%02d_%s', step, action), z::int, x, y, chunks, false, decimation from ({_LOOK} select * from seen)",
    )
)


@query(f"select * from ({_ALL})")
def tile_scenarios(spark, d):
    """All tiles to be timed, by name."""
    return tiles.scenarios(grids(spark, d))


# Layout records of all kinds.


def layout_records(spark, d):
    """Each part an object of one of the five kinds."""
    k, s = F.col("p_partkey"), F.col("p_size")
    own = views.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("o"), k.cast("string")).alias("name"), (s * 1000).cast("long").alias("size"), F.when(s % 4 != 0, F.col("p_type")).alias("codec"), F.when(s % 3 != 0, s / 8.0).alias("ratio"), k.alias("k"), s.alias("s"))
    some = lambda *names: F.array(*[F.lit(x) for x in names])
    told = {
        "raster": {"tiled": s25(), "block_rows": F.lit(256), "block_cols": F.col("s") * 8, "overviews": F.col("s") % 5, "tiles": F.col("s") * 3, "bands": F.when(F.col("s") % 2 == 0, some("A", "N"))},
        "store": {"chunk": some(64, 64), "shard": F.array(F.lit(256), F.col("s") * 10), "levels": F.col("s") % 3, "shards": F.col("s"), "native_level": F.when(F.col("s") % 5 != 0, F.col("s") % 2), "overview_bytes": F.when(F.col("s") % 3 > 0, F.col("s") * 100).otherwise(0), "stored": F.when(F.col("s") % 2 == 0, "int16"), "unscaled": F.col("s") % 7 == 0, "grid": F.when(F.col("s") % 4 > 0, F.concat(F.lit("grid"), F.col("s") % 4))},
        "columnar": {"geometry": F.lit("geometry"), "features": F.col("s") * 11, "row_groups": F.col("s"), "group_rows": F.lit(11), "covering": F.col("s") % 2 == 1},
        "indexed": {"geometry": F.lit("Point"), "features": F.col("s") * 7, "dropped": F.col("s") % 3, "made": F.col("s") % 4, "placed": F.when(F.col("s") > 40, F.col("s") % 2).otherwise(0), "indexed": s25(), "node_size": F.lit(16), "index_bytes": F.when(s25(), F.col("s") * 40).otherwise(0)},
        "octree": {"nodes": F.col("s"), "depth": F.col("s") % 6, "points": F.col("s") * 100, "node_points": F.lit(100), "carried": F.when(F.col("s") % 2 == 0, some("height", "class")).otherwise(some("height"))},
    }
    parts = [layouts.records(own.where(F.col("k") % 5 == at).withColumns(columns), kind).join(own.select("name", "brand"), "name") for at, (kind, columns) in enumerate(told.items())]
    return layouts.united(parts)


def s25():
    return F.col("s") > 25


@query(None)
def layouts_written(spark, d):
    """Records of what was written: features as columns and indexed, points in an octree, growing rasters as a store."""
    from quarry.plans.products import _growing

    base = f"{shared_dir(spark)}/quarry/layouts-{uuid.uuid4().hex}"
    features = views.features(spark, d)
    made = [
        ("columnar", features.where("xmin is not null"), {"partitions": 2, "row_group_rows": 500}),
        ("indexed", features, {"null_geometry": "drop", "node_size": 8}),
        ("octree", views.points(spark, d), {"span": 4}),
        ("store", _growing(spark, d).withColumn("pixel", F.when(F.col("component") == "A", 10.0).otherwise(30.0)), {"chunk": [32, 16], "shard": [64, 64], "levels": [30.0, 90.0]}),
    ]
    out = []
    for name, df, options in made:
        own = kinds.get(name)
        own.write(df, f"{base}/{name}", options_of(own.options, options))
        out.append(own.records(spark, f"{base}/{name}"))
    rows = layouts.united(out)
    told = {"columnar": ("features", "covering"), "indexed": ("features", "dropped", "index_bytes", "node_size"), "octree": ("nodes", "depth", "points", "node_points"), "store": ("levels", "shards", "native_level")}
    pairs = F.array(*[F.when(F.col("kind") == kind, F.struct(F.lit(n).alias("detail"), layouts.detail(n, "string").alias("value"))) for kind, names in told.items() for n in names])
    shown = rows.select("kind", F.when(F.col("kind") == "store", F.col("name")).alias("array"), F.explode(F.array_compact(pairs)).alias("p")).select("kind", "array", "p.*")
    # Files are as many as ranges turn out to be, so what they hold counts together.
    files = shown.where("kind = 'columnar'").groupBy("kind", "array", "detail").agg(F.when(F.col("detail") == "features", F.sum(F.col("value").try_cast("long")).cast("string")).otherwise(F.max("value")).alias("value"))
    return shown.where("kind <> 'columnar'").unionByName(files)


_SHARDS = "select component, level, count(distinct row((\"row\" // 32) // 2, (col // 16) // 4)) as shards from ({of}) group by component, level"
ORACLE["layouts_written"] = (
    with_views("", "features").rstrip()
    + f", kept as (select count(*) filter (xmin is not null) as n, count(*) filter (xmin is null) as dropped from features), pyr as ({ORACLE['pyramid_bundle']}), s as ({_SHARDS.format(of='select * from pyr')}), o as ({ORACLE['octree_node_counts']}), depth(n, total) as (select n, n from kept union all select ceil(n / 8.0)::bigint, total + ceil(n / 8.0)::bigint from depth where n > 1) "
    "select kind, \"array\", detail, value::varchar as value from (select 'columnar' as kind, null::varchar as \"array\", 'features' as detail, n::varchar as value from kept union all select 'columnar', null, 'covering', 'true' union all select 'indexed', null, 'features', n::varchar from kept union all select 'indexed', null, 'dropped', dropped::varchar from kept union all select 'indexed', null, 'node_size', '8' union all select 'indexed', null, 'index_bytes', (max(total) * 40)::varchar from depth "
    "union all select 'octree', null, 'nodes', sum(nodes)::bigint::varchar from o union all select 'octree', null, 'points', sum(points)::bigint::varchar from o union all select 'octree', null, 'depth', max(depth)::varchar from o union all select 'octree', null, 'node_points', max(max_node_points)::varchar from o "
    "union all select 'store', component, 'shards', sum(shards)::bigint::varchar from s group by component union all select 'store', component, 'levels', (count(*) - 1)::varchar from s group by component union all select 'store', component, 'native_level', min(level)::varchar from s group by component)"
).replace("with ", "with recursive ", 1)


_OWN = "own as (select p_brand as brand, 'o' || p_partkey as name, (p_size * 1000)::bigint as size, coalesce(case when p_size % 4 <> 0 then p_type end, '-') as codec, case when p_size % 3 <> 0 then printf('%.2fx', p_size / 8.0) else '-' end as ratio, p_partkey % 5 as kind, p_size::bigint as s, ['raster', 'store', 'columnar', 'indexed', 'octree'][p_partkey % 5 + 1] as kind_name from part)"
_B = "case when ({n}) < 1024 then printf('%d B', ({n})::bigint) when ({n}) < 1048576 then printf('%.1f KiB', round_even(({n}) / 1024.0, 1)) else printf('%.1f MiB', round_even(({n}) / 1048576.0, 1)) end"
_TAIL = f" || ' | ' || {_B.format(n='size')} || ' | ' || codec || ' | ' || ratio || ' |'"


@query(
    f"with {_OWN} select brand, kind_name as kind, name, '| ' || name || ' | ' || case kind "
    "when 0 then case when s > 25 then 'yes' else 'no' end || ' | 256x' || s * 8 || ' | ' || s % 5 || ' | ' || s * 3 || ' | ' || case when s % 2 = 0 then 'A, N' else '-' end "
    "when 1 then '64x64 | 256x' || s * 10 || ' | ' || (4 * greatest(1, s * 10 // 64)) || ' | ' || s % 3 || ' | ' || s || ' | ' || case when s % 7 = 0 then 'unscaled by readers' || case when s % 2 = 0 then ' as int16' else '' end when s % 2 = 0 then 'int16' else '-' end || ' | ' || case when s % 4 > 0 then 'grid' || s % 4 else '-' end || ' | ' || case when s % 5 = 0 then '-' when s % 3 > 0 then s % 2 || ' native, ' || (s % 2 + 1) || ' to ' || (s % 2 + s % 3) || ' derived' else s % 2 || ' native' end "
    "when 2 then 'geometry | ' || s * 11 || ' | ' || s || ' | 11 | ' || case when s % 2 = 1 then 'yes' else 'no' end "
    f"when 3 then 'Point | ' || s * 7 || ' | ' || s % 3 || ' | ' || s % 4 || ' | ' || case when s > 40 then s % 2 else 0 end || ' | ' || case when s > 25 then 'yes' else 'no' end || ' | 16 | ' || {_B.format(n='case when s > 25 then s * 40 else 0 end')} || ' | ' || {_B.format(n='size - case when s > 25 then s * 40 else 0 end')} "
    f"else s || ' | ' || s % 6 || ' | ' || s * 100 || ' | 100 | ' || case when s % 2 = 0 then 2 else 1 end end {_TAIL} as line from own"
)
def layout_cells(spark, d):
    """A line for each object of each kind, by its own cells."""
    rows = layout_records(spark, d)
    out = None
    for kind in layouts.TABLES:
        one = layouts.cells(rows, kind, ["brand"])
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def layout_lines(spark, d):
    """What the objects of each kind come to, by brand."""
    rows = layout_records(spark, d)
    out = None
    for kind in layouts.TABLES:
        one = layouts.totals(rows, kind, ["brand"])
        out = one if out is None else out.unionByName(one)
    return out


_PER = "case when {w} > 0 then printf('%.1f %%', round_even(100.0 * {p} / {w}, 1)) else '-' end"
ORACLE["layout_lines"] = f"with {_OWN}, g as (select brand, kind_name as kind, count(*) as n, sum(size) as b, sum(s) as s, count(*) filter (s > 25) as big, count(*) filter (s % 2 = 0) as even, count(distinct case when s % 4 > 0 then s % 4 end) as grids, coalesce(sum(case when s % 3 > 0 then s * 100 else 0 end), 0) as over, count(*) filter (s % 3 = 0) as flat, count(*) filter (s % 7 = 0) as unscaled, coalesce(sum(case when s > 25 then s * 40 else 0 end), 0) as ix, sum(s % 3) as dropped, count(*) filter (s % 3 > 0) as dropped_files, sum(s % 4) as made, count(*) filter (s % 4 > 0) as made_files, sum(case when s > 40 then s % 2 else 0 end) as placed, count(*) filter (s > 40 and s % 2 = 1) as placed_files from own group by all), l as (" + " union all ".join(
    f"select brand, kind, {place} as place, {line} as line from g where kind = '{kind}' and {when}"
    for kind, place, when, line in (
        ("raster", 0, "true", "printf('* %d of %d objects are tiled, %d in strips', big, n, n - big)"),
        ("raster", 1, "even > 0", "printf('* %d objects hold several components, a band each', even)"),
        ("store", 0, "true", "printf('* %d shards in %d arrays', s::bigint, n)"),
        ("store", 1, "grids > 0", "printf('* %d arrays share %d grids', n, grids)"),
        ("store", 2, "over > 0", f"'* Overviews are ' || {_B.format(n='over')} || ' of ' || {_B.format(n='b')} || ', ' || {_PER.format(p='over', w='b')}"),
        ("store", 2, "over = 0 and flat > 0", "'* Without overviews: far views read full-resolution chunks'"),
        ("store", 3, "unscaled > 0", "printf('* %d arrays are scaled by their own codec', unscaled)"),
        ("columnar", 0, "true", "printf('* %d of %d files have boxes by which row groups are skipped', n - even, n)"),
        ("indexed", 0, "true", "printf('* %d of %d files have an index', big, n)"),
        ("indexed", 1, "true", f"'* Indexes are ' || {_B.format(n='ix')} || ', ' || {_PER.format(p='ix', w='b')}"),
        ("indexed", 2, "dropped_files > 0", "printf('* %d files lack %d features without geometry, so they aren''t the whole source', dropped_files, dropped::bigint)"),
        ("indexed", 3, "made_files > 0", "printf('* %d files have %d geometries made from columns', made_files, made::bigint)"),
        ("indexed", 4, "placed_files > 0", "printf('* %d files have %d geometries that only hold a place', placed_files, placed::bigint)"),
        ("octree", 0, "true", "printf('* %d nodes in %d files', s::bigint, n)"),
        ("octree", 1, "true", "'* Points carry ' || case when even > 0 then 'class, height' else 'height' end"),
    )
) + ") select * from l"
