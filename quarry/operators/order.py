"""Places of rows in an order, without one task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import free_names


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "place", cut: Callable | None = None) -> DataFrame:
    """Column ``name``: place of each row from 0 within its group by an order, which should have no ties.

    Rows are dealt by ranges of group and order, numbered within each range, and moved
    on by the rows of the ranges before; a group of any size spreads over tasks.
    ``cut`` (a function of DataFrame and name) writes the ranges, so that both uses see
    the same ones; by default they go into the folder of spark.checkpoint.dir.
    A column of that name is replaced; all others stay.
    """
    if cut is None:
        from quarry.plans.tables import written as cut
    part, at, n, before = free_names(rows, "_range", "_at", "_n", "_before")
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part, *by).agg(F.count("*").alias(n))
    # A row for each range and group in it.
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = free_names(rows, *[f"_by{k}" for k in range(len(by))])
    moved = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).select(F.col(part).alias(at), before, *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)])
    same = F.col(part) == F.col(at)
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    place = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1
    return ranged.withColumn(n, place).join(moved, same).select(*[c for c in rows.columns if c.lower() != name.lower()], (F.col(n) + F.col(before)).alias(name))
