"""Mosaics and stacks: where each source lies, whether sources fit on one grid, colours from three bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered
from quarry.operators.raster import offset_in_mosaic

EDGES = ("xmin", "ymin", "xmax", "ymax")


def nodata_of(component: Column, run: Column, header: Column) -> Column:
    """What stands for missing cells: the component's value, else the run's, else the file's."""
    return F.coalesce(component, run, header)


def placements(sources: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Sources (by, order, xmin, ymin, xmax, ymax, pixel) with the place of each in the mosaic of its group.

    Added are ``col_off`` and ``row_off`` in whole pixels from the upper left corner of
    the union of all sources, and the union's ``mosaic_cols`` and ``mosaic_rows``, 1 at
    least.  The first source's pixel size counts.
    """
    whole = sources.groupBy(*by).agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"), F.min_by("pixel", order).alias("p")).select(*[F.col(c).alias(f"_{c}") for c in by], "x0", "y0", "x1", "y1", "p")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    side = lambda low, high: F.greatest(F.lit(1), offset_in_mosaic(F.col(high), F.col(low), F.col("p")))
    return sources.join(whole, same).select(*sources.columns, offset_in_mosaic(F.col("xmin"), F.col("x0"), F.col("p")).alias("col_off"), offset_in_mosaic(F.col("y1"), F.col("ymax"), F.col("p")).alias("row_off"), side("x0", "x1").alias("mosaic_cols"), side("y0", "y1").alias("mosaic_rows"))


def rgb(cells: DataFrame, bands: Sequence[str], gap: float = 0.0) -> DataFrame:
    """(row, col, red, green, blue) of cells (band, ordinal, row, col, value, nodata, col_off, row_off).

    Per band later sources cover earlier ones where they have data; a place without
    data in a band is ``gap`` there.  The extent is shared, so a cell is given where any
    band has data.  One aggregation by cell.
    """
    if len(bands) != 3:
        raise ValueError(f"a colour mosaic has 3 bands, not {len(bands)}")
    there = cells.where(F.col("band").isin(list(bands)) & F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("nodata")))
    of = lambda b: F.coalesce(F.max_by(F.when(F.col("band") == b, F.col("value")), F.when(F.col("band") == b, F.col("ordinal"))), F.lit(gap))
    return there.groupBy((F.col("row") + F.col("row_off")).alias("row"), (F.col("col") + F.col("col_off")).alias("col")).agg(*[of(b).alias(c) for b, c in zip(bands, ("red", "green", "blue"), strict=True)])


def homogeneity(members: DataFrame, by: Sequence[str], grid: Sequence[str], nodata: str) -> DataFrame:
    """(by, members, grids, nodatas, stackable) of each group: how many different grids and no-data values its members have; null counts as a value.

    Equal ones are counted first, so a hot group sends as many rows as it has different pairs.
    """
    kinds = members.groupBy(*by, F.struct(*grid).alias("grid"), F.struct(nodata).alias("missing")).agg(F.count("*").alias("n"))
    out = kinds.groupBy(*by).agg(F.sum("n").alias("members"), F.count_distinct("grid").alias("grids"), F.count_distinct("missing").alias("nodatas"))
    return out.withColumn("stackable", (F.col("grids") == 1) & (F.col("nodatas") == 1))


def require_one_grid(members: DataFrame, name: str, grid: Sequence[str], nodata: str, shown: int = 20) -> DataFrame:
    """The members of one stack; several grids or no-data values raise, with the first names of each."""
    for what, keys in (("grids", list(grid)), ("no-data values", [nodata])):
        kinds = members.groupBy(*keys).agg(F.min(name).alias("first"), F.count("*").alias("n")).orderBy("first").limit(shown).collect()
        if len(kinds) > 1:
            raise ValueError(f"a stack has one grid and one no-data value; several {what}: " + "; ".join(f"{', '.join(f'{k}={r[k]}' for k in keys)}: {r['first']}{f' and {r.n - 1} more' if r.n > 1 else ''}" for r in kinds))
    return members


def stack_bands(members: DataFrame, name: str, order: str, edges: Sequence[str] = EDGES, shape: Sequence[str] = ("rows", "cols"), wanted: Sequence[str] | None = None) -> DataFrame:
    """(band, name) of the members of one stack, numbered from 1 in order.

    Members that don't share one extent and shape are an error that names the first of
    each, as are none, and names asked for that aren't those that there are.
    """
    kinds = members.groupBy(*edges, *shape).agg(F.min(name).alias("first"), F.count("*").alias("n")).orderBy("first").limit(5).collect()
    if not kinds:
        raise ValueError("a stack has one member at least")
    if len(kinds) > 1:
        raise ValueError("members of a stack share one extent and shape; there are " + "; ".join(f"{r['first']} ({r.n}): {[r[k] for k in (*edges, *shape)]}" for r in kinds))
    if wanted is not None:
        named = members.where(F.col(name).isin(list(wanted))).select(name).distinct().count()
        if (n := members.count()) != len(wanted) or named != len(set(wanted)):
            raise ValueError(f"{len(wanted)} bands are named, and {n} members are there, {named} of them by these names")
    return numbered(members.select(order, name), [order, name], name="_band").select((F.col("_band") + 1).cast("int").alias("band"), name)
