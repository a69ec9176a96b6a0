"""Measurements: write roll-ups, worker merges, replicate statistics, pooled conditions, read latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import numbered

CONDITION = ("phase", "cache", "concurrency")


def throughput(amount: Column, seconds: Column) -> Column:
    """Amount a second; infinite where no time passed."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(float("inf")))


def write_rollup(writes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over components; bytes_in is null where no component has it.  Sums are made in decimals, so they don't depend on the order of the rows.

    A row that stands for several components says so in a column ``components``.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double").alias(c)
    out = writes.groupBy(*by).agg(exact("elapsed"), exact("bytes_out"), exact("bytes_in"), (F.sum("components") if "components" in writes.columns else F.count("*")).cast("long").alias("components"))
    return out.withColumn("throughput", throughput(F.col("bytes_out"), F.col("elapsed")))


def charge_once(components: DataFrame, product: str, container: str, order: str, size: str) -> DataFrame:
    """Of each product the size of its first component's container, and no other: a container is read once."""
    return components.groupBy(product).agg(F.min_by(F.struct(container, size), F.col(order)).alias("c")).select(product, F.col(f"c.{container}").alias(container), F.col(f"c.{size}").alias("charged_bytes"))


def first_n(rows: DataFrame, n: int, by: str, *order: str) -> DataFrame:
    """The first n rows of each group in order; the limit is taken before rows move."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def merge_workers(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value a metric and replicate: the mean over its workers."""
    return measured.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("workers"))


def replicate_statistics(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and population deviation over replicates."""
    return merged.groupBy(*keys).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("spread"), F.count("*").alias("replicates"))


def pool_conditions(merged: DataFrame, condition: Sequence[str], metric: str, product: str, replicate: str) -> DataFrame:
    """Replicates of all products numbered anew from 0 within a condition and metric; statistics over the pool follow from these rows."""
    return numbered(merged, [product, replicate], [*condition, metric], "pooled_replicate")


def latency_summary(reads: DataFrame, by: Sequence[str], seconds: str, amount: str, counted: str | None = None, item_bytes: int | None = None) -> DataFrame:
    """Count, mean, median, population deviation and throughput of reads.

    Reads of features or points also say how many came: ``counted`` is their column, and
    the sum of it has its name.  Where items have a fixed size, ``item_bytes``, the amount is that many times the count.
    """
    amount = F.sum(F.col(counted) * item_bytes) if counted and item_bytes else F.sum(amount)
    items = [F.sum(counted).cast("long").alias(counted)] if counted else []
    return reads.groupBy(*by).agg(F.count("*").alias("reads"), F.avg(seconds).alias("mean"), F.median(seconds).alias("p50"), F.stddev_pop(seconds).alias("spread"), throughput(amount, F.sum(seconds)).alias("throughput"), *items)
