"""Rasters as long tables of cells (row, col, value): windows, pyramids, stacks, mosaics, packing, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered

#: Rows from which one task makes cells: some 200 MB.
TASK_ROWS = 500_000


def _tasks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys to as many tasks as have about ``TASK_ROWS`` each, so that what a task groups doesn't grow with the table.  Counting is a pass of its own, which a written table answers from its footers; groups over the keys and more need no further exchange."""
    return rows.repartition(_tasks(rows), *keys)


def ranged(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """The same by ranges of the keys, so that a task has neighbours."""
    return rows.repartitionByRange(_tasks(rows), *keys)


def in_window(row: int, col: int, height: int, width: int) -> Column:
    """Half-open window; a plain predicate, so it is pushed to the scan."""
    return (F.col("row") >= row) & (F.col("row") < row + height) & (F.col("col") >= col) & (F.col("col") < col + width)


def window_reads(cells: DataFrame, windows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(window, cell columns) of few windows (window, row, col, height, width) from the driver.

    Each cell is asked for all windows in one pass, without a join; the window about all of them is a plain filter that reaches the scan.
    """
    if not windows:
        return cells.withColumn("window", F.lit(0)).limit(0)
    top, left = min(w[1] for w in windows), min(w[2] for w in windows)
    near = cells.where(in_window(top, left, max(w[1] + w[3] for w in windows) - top, max(w[2] + w[4] for w in windows) - left))
    hits = [F.when(in_window(*w[1:]), F.lit(w[0])) for w in windows]
    return near.withColumn("window", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def block_mean(cells: DataFrame, factor: int, rows: int, cols: int, fill: float | None = None, integer: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One level coarser: means over factor x factor blocks of cells that aren't fill; all fill gives fill; a ragged edge is left out; whole-number types are cut towards zero."""
    inside = (F.col("row") < rows // factor * factor) & (F.col("col") < cols // factor * factor)
    value = F.col("value") if fill is None else F.when(F.col("value") != fill, F.col("value"))
    mean = F.avg(value)
    mean = mean if fill is None else F.coalesce(mean, F.lit(fill))
    if integer:
        mean = mean.cast("long").cast("double")
    return cells.where(inside).groupBy(*by, F.expr(f"row div {factor}").cast("long").alias("row"), F.expr(f"col div {factor}").cast("long").alias("col")).agg(mean.alias("value"))


def pyramid(cells: DataFrame, rows: int, cols: int, factors: Sequence[int], fill: float | None = None, integer: bool = False) -> DataFrame:
    """(level, row, col, value): each level from the one before it, so that casts add up; ends when a side is shorter than the factor."""
    out = cells.select(F.lit(0).alias("level"), "row", "col", "value")
    for level, factor in enumerate(factors, 1):
        if min(rows, cols) < factor:
            break
        cells = block_mean(cells, factor, rows, cols, fill, integer)
        rows, cols = rows // factor, cols // factor
        out = out.unionByName(cells.select(F.lit(level).alias("level"), "row", "col", "value"))
    return out


def stack(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """A column for each band by cell; the bands are named, so no pass is needed to find them.  One grouping makes all bands; of several values of a band in a cell the largest counts."""
    return cells.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == F.lit(b), F.col("value"))).alias(str(b)) for b in bands])


def mosaic(cells: DataFrame, nodata: float) -> DataFrame:
    """Cells of sources (ordinal, row, col, value) on a shared grid: later sources cover earlier ones where they have data."""
    return cells.where(F.col("value") != nodata).groupBy("row", "col").agg(F.max_by("value", "ordinal").alias("value"))


def offset_in_mosaic(edge: Column, least: Column, pixel: Column) -> Column:
    """Whole pixels from the mosaic's edge; halves go to the even neighbour."""
    return F.rint((edge - least) / pixel).cast("long")


def pack(value: Column, scale: float, offset: float) -> Column:
    return F.rint((value - offset) / scale).cast("int")


def unpack(value: Column, scale: float, offset: float) -> Column:
    return value.cast("double") * scale + offset


def blocks(cells: DataFrame, rows: int, cols: int, side: int) -> DataFrame:
    """Cells of each block in row order: what a tiled layout stores together."""
    key = [F.expr(f"row div {side}").alias("block_row"), F.expr(f"col div {side}").alias("block_col")]
    return cells.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda c: c["value"]).alias("values"))


def shard_objects(cells: DataFrame, chunk: int, per_shard: int, item_bytes: int, fill: float) -> DataFrame:
    """Objects of a sharded store: a shard holds per_shard x per_shard chunks, and chunks that are fill alone aren't stored."""
    chunks = cells.groupBy(F.expr(f"row div {chunk}").alias("cr"), F.expr(f"col div {chunk}").alias("cc")).agg(F.count_if(F.col("value") != fill).alias("filled"))
    kept = chunks.where("filled > 0")
    return kept.groupBy(F.expr(f"cr div {per_shard}").alias("shard_row"), F.expr(f"cc div {per_shard}").alias("shard_col")).agg(F.count("*").alias("chunks"), (F.count("*") * chunk * chunk * item_bytes).alias("size"))


def write_store(levels: DataFrame, path: str, side: int) -> None:
    """A level's blocks in a folder of its own, in block order."""
    keyed = levels.withColumns({"block_row": F.expr(f"row div {side}"), "block_col": F.expr(f"col div {side}")})
    keyed.repartitionByRange("level", "block_row", "block_col").sortWithinPartitions("level", "block_row", "block_col", "row", "col").write.partitionBy("level").mode("overwrite").parquet(path)


def group_grids(grids: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """Members of one and the same grid: (keys, members, grid id by first appearance)."""
    grouped = grids.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("members"))
    return numbered(grouped, ["first", *keys], name="_grid").withColumn("grid", F.concat(F.lit("grid"), "_grid")).drop("_grid")
