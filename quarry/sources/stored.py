"""Layouts of chunked stores, octrees and indexed features: writers with typed options, and records of what they wrote.

Beside the data lies ``written``, a row with the options and what was counted on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.grid import index_bytes
from quarry.functions.names import free_name
from quarry.operators import ladders, layouts, points, raster, rtree, spatial
from quarry.sources.listing import list_objects
from quarry.sources.options import Indexed, Kind, Store, Tree
from quarry.sources.registry import layouts as registered

NOTE = "written"


def _note(spark, path: str, **what) -> None:
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in what.items()]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{NOTE}")


def _sizes(spark, path: str) -> DataFrame:
    """(key, size) of data files; Spark's own marks aren't data."""
    return list_objects(spark, path).where(~F.regexp_like("key", F.lit(r"(^|/)[_.][^/]*$"))).select("key", "size")


def _name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


class StoreLayout:
    """Cells (component, row, col, value) of rasters on one grid, or with a column ``pixel`` on several, as chunks in shards, with their pyramid."""

    kind, options = Kind.STORE, Store

    def write(self, df: DataFrame, path: str, options: Store, fill: float | None = None) -> None:
        from quarry.plans.tables import written

        spark = df.sparkSession
        rows, cols = options.chunk_sides
        pixel = F.col("pixel").cast("double") if "pixel" in df.columns else F.lit(1.0)
        cells = written(df.select("component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), pixel.alias("pixel")), "store-cells")
        grids = cells.groupBy("component").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.min("pixel").alias("pixel"))
        ladder = ladders.ladder(grids, 0 if options.flat else options.levels)
        levels = ladders.unified_pyramid(cells.drop("pixel"), ladder, fill=fill)
        # Along an axis a shard holds whole chunks, one at least; ``auto`` is a shard for all of a raster.
        shard = options.shard_sides
        per = (F.lit(1 << 40), F.lit(1 << 40)) if shard == "auto" else tuple(F.lit(max(1, s // c)) for s, c in zip(shard, (rows, cols), strict=True))
        cell = F.struct((F.col("row") % rows).cast("int").alias("row"), (F.col("col") % cols).cast("int").alias("col"), "value")
        stored = levels if fill is None else levels.where(F.col("value") != fill)
        stored = stored.withColumns({"chunk_row": F.expr(f"row div {rows}"), "chunk_col": F.expr(f"col div {cols}")})
        stored = stored.withColumns({"shard_row": F.floor(F.col("chunk_row") / per[0]), "shard_col": F.floor(F.col("chunk_col") / per[1])})
        order, chunk = ("component", "level", "shard_row", "shard_col"), ("chunk_row", "chunk_col")
        # Cells move once, to the task that writes their shard, and become chunks there.  The level stays out of the ranges: a single one is a constant, by which no range is known.
        chunks = raster.ranged(stored, "component", "shard_row", "shard_col").groupBy(*order, *chunk).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        chunks.select("component", "level", *chunk, "cells", "shard_row", "shard_col").sortWithinPartitions(*order, *chunk).write.partitionBy("component", "level").mode("overwrite").parquet(f"{path}/arrays")
        _note(spark, path, chunk_rows=rows, chunk_cols=cols, shard_rows=0 if shard == "auto" else shard[0], shard_cols=0 if shard == "auto" else shard[1])

    def describe(self, spark, path: str) -> DataFrame:
        """(component, level, shards, chunks, size) of what was written."""
        arrays = spark.read.parquet(f"{path}/arrays")
        each = arrays.groupBy("component", "level").agg(F.count_distinct("shard_row", "shard_col").alias("shards"), F.count("*").alias("chunks"))
        size = _sizes(spark, f"{path}/arrays").groupBy(F.regexp_extract("key", r"component=([^/]*)/", 1).alias("component"), F.regexp_extract("key", r"level=(\d+)/", 1).cast("int").alias("level")).agg(F.sum("size").alias("size"))
        return each.join(size, ["component", "level"], "left")

    def records(self, spark, path: str) -> DataFrame:
        """A record for each component."""
        note = spark.read.parquet(f"{path}/{NOTE}").first()
        each = self.describe(spark, path).groupBy("component").agg(F.sum("shards").alias("shards"), F.sum("size").alias("size"), F.min("level").alias("native_level"), F.count("*").alias("there"), F.min_by("size", "level").alias("native"))
        sides = lambda a, b: F.array(F.lit(a), F.lit(b)) if a else F.lit(None).cast("array<int>")
        told = each.withColumns({"name": F.col("component").cast("string"), "chunk": sides(note.chunk_rows, note.chunk_cols), "shard": sides(note.shard_rows, note.shard_cols), "levels": F.col("there") - 1, "overview_bytes": F.col("size") - F.col("native")})
        return layouts.records(told.drop("component"), "store")


class OctreeLayout:
    """Points (pid, x, y, z and what they carry) in nodes of an octree."""

    kind, options = Kind.POINTS, Tree

    def write(self, df: DataFrame, path: str, options: Tree) -> None:
        points.write_octree(df, path, options.span, options.most_depth)

    def describe(self, spark, path: str) -> DataFrame:
        """(depth, nodes, points, largest node) of each depth."""
        nodes = spark.read.parquet(f"{path}/nodes")
        return nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.sum("points").alias("points"), F.max("points").alias("max_node_points"))

    def records(self, spark, path: str) -> DataFrame:
        """One record."""
        carried = points.carried(spark.read.parquet(f"{path}/points"), ["pid", "x", "y", "z"], exclude=points.PLACE)
        told = self.describe(spark, path).agg(F.sum("nodes").alias("nodes"), F.max("depth").alias("depth"), F.sum("points").alias("points"), F.max("max_node_points").alias("node_points"))
        size = _sizes(spark, f"{path}/points").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
        ratio = F.when(F.col("size") > 0, F.col("points") * points.POINT_BYTES / F.col("size"))
        one = told.crossJoin(size).withColumns({"name": F.lit(_name(path)), "ratio": ratio, "carried": F.array(*[F.lit(c) for c in carried]).cast("array<string>")})  # a row each
        return layouts.records(one, "octree")


class IndexedLayout:
    """Features in curve order under a packed R-tree; those without geometry as their policy has it."""

    kind, options = Kind.VECTOR, Indexed

    def write(self, df: DataFrame, path: str, options: Indexed) -> None:
        spark = df.sparkSession
        flag = free_name(df, "null_geometry")
        whole = spatial.with_null_policy(df, options.null_geometry, options.lon, options.lat)
        missing = df.where(F.col("xmin").isNull()).count() if options.null_geometry != "error" else 0
        rtree.write_rtree(whole, path, options.node_size)
        _note(spark, path, node_size=options.node_size, flag=flag, **{c: missing if options.null_geometry == p else 0 for c, p in (("dropped", "drop"), ("made", "point_from"), ("placed", "sentinel"))})

    def describe(self, spark, path: str) -> DataFrame:
        """(level, nodes, children) of the tree."""
        return spark.read.parquet(f"{path}/nodes").groupBy("level").agg(F.count("*").alias("nodes"), F.sum("children").alias("children"))

    def records(self, spark, path: str) -> DataFrame:
        """One record; the index is charged by the format's formula."""
        note = spark.read.parquet(f"{path}/{NOTE}").first()
        features = self.describe(spark, path).where("level = 0").agg(F.coalesce(F.sum("children"), F.lit(0)).alias("features"))
        size = _sizes(spark, f"{path}/features").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("data"))
        told = features.crossJoin(size).withColumn("index_bytes", index_bytes(F.col("features"), F.lit(note.node_size)))  # a row each
        one = told.withColumns({"name": F.lit(_name(path)), "size": F.col("data") + F.col("index_bytes"), "geometry": F.lit("box"), "indexed": F.lit(True), "node_size": F.lit(note.node_size), **{c: F.lit(note[c]) for c in ("dropped", "made", "placed")}})
        return layouts.records(one, "indexed")


registered.register("store", StoreLayout())
registered.register("octree", OctreeLayout())
registered.register("indexed", IndexedLayout())
