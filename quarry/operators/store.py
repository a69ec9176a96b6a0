"""Layouts of chunked stores from their listings: shards, levels, overviews, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of an array's chunks, and the file beside them that holds no data.
CHUNKS, METADATA = "c", "zarr.json"


def shards(listing: DataFrame, group: str | None = None, array: str | None = None) -> DataFrame:
    """Objects (key, size, ...) that hold chunks, with ``array``, the folder that the chunks are in, and ``level``.

    A level is a whole number that begins the key, or follows the group; else 0.
    """
    parts = F.split("key", "/")
    at = F.array_position(parts, CHUNKS).cast("int")
    head = F.try_element_at(parts, F.lit(2 if group else 1))
    out = listing.where((F.array_position(parts, CHUNKS) > 0) & (F.element_at(parts, -1) != METADATA))
    if group:
        out = out.where(F.col("key").startswith(f"{group}/"))
    out = out.withColumns({"array": F.when(at > 1, F.try_element_at(parts, at - 1)).otherwise(""), "level": F.when(F.regexp_like(head, F.lit(r"^\d+$")), head.try_cast("int")).otherwise(0)})
    return out.where(F.col("array") == array) if array is not None else out


def store_layout(of: DataFrame, by: Sequence[str], uncompressed: str | None = None) -> DataFrame:
    """(by, shards, size, native_level, overview_bytes, overview_share, ratio) of shards: what lies above the finest level that there is counts as overview."""
    leveled = of.groupBy(*by, "level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), (F.sum(uncompressed) if uncompressed else F.lit(None).cast("long")).alias("raw"))
    # One row for each level, so the levels of a group fit in one list.
    grouped = leveled.groupBy(*by).agg(F.sum("n").alias("shards"), F.sum("bytes").alias("size"), F.min("level").alias("native_level"), F.min_by("bytes", "level").alias("native"), F.sum("raw").alias("raw"))
    over = F.col("size") - F.col("native")
    share = F.when(F.col("size") > 0, over / F.col("size")).otherwise(0.0)
    return grouped.select(*by, "shards", "size", "native_level", over.alias("overview_bytes"), share.alias("overview_share"), F.when(F.col("size") > 0, F.col("raw") / F.col("size")).otherwise(0.0).alias("ratio"))


def level_resolution(a: Column, e: Column, otherwise: Column) -> Column:
    """Pixel size of a level: the smaller side of a pixel, or another value where the level has no transform."""
    return F.when(a.isNotNull() & e.isNotNull(), F.least(F.abs(a), F.abs(e))).otherwise(otherwise)


def finest_level(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, finest, unified) of (by, group, has_scales): the least whole number among its groups, null where the array lies at the root; ``unified`` where the root itself declares levels."""
    number = F.when(F.regexp_like("group", F.lit(r"^\d+$")), F.col("group").try_cast("int"))
    return levels.groupBy(*by).agg(F.min(number).alias("finest"), F.coalesce(F.bool_or((F.col("group") == "") & F.col("has_scales")), F.lit(False)).alias("unified"))


def layout_totals(layouts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: objects, tiled ones, shards, different grids, shares of overviews and of indexes in the bytes, how many have boxes, different carried columns."""
    share = lambda part: F.when(F.sum("size") > 0, 100 * F.coalesce(F.sum(part), F.lit(0)) / F.sum("size")).otherwise(0.0)
    totals = layouts.groupBy(*by).agg(F.count("*").alias("objects"), F.count_if("tiled").alias("tiled"), F.coalesce(F.sum("shards"), F.lit(0)).alias("shards"), F.count_distinct("grid").alias("grids"), share("overview_bytes").alias("overview_share"), share("index_bytes").alias("index_share"), F.count_if("has_box").alias("with_box"))
    carried = layouts.select(*by, F.explode_outer("carried").alias("one")).groupBy(*by).agg(F.count_distinct("one").alias("carried"))
    named = carried.select(*[F.col(c).alias(f"_{c}") for c in by], "carried")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return totals.join(named, same).drop(*[f"_{c}" for c in by])
