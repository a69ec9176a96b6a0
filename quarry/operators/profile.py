"""Object-size profiles: exact statistics, histograms with empty bins, tiers, and the roll-up over products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, smallest mean object size in bytes), as in the usual storage policies.
TIERS = (("warm", 32 << 20), ("cold", 100 << 20))


def validated(sizes: DataFrame, size: str = "size") -> DataFrame:
    """The rows; a negative or null size raises when the plan runs."""
    bad = F.col(size).isNull() | (F.col(size) < 0)
    return sizes.withColumn(size, F.when(bad, F.raise_error(F.format_string("object size %s is not a whole number from 0", F.col(size).cast("string"))).cast("long")).otherwise(F.col(size)))


def size_profile(sizes: DataFrame, by: Sequence[str] = (), size: str = "size", rollup: bool = False) -> DataFrame:
    """count, total, mean, median, p50, p90, p95, p99, smallest, largest of each group, and of all with ``rollup`` (then ``is_rollup`` tells).

    Equal sizes are counted first, so a hot group sends as many rows as it has
    different sizes, and percentiles are exact (type 7) over the pool.
    """
    counted = sizes.groupBy(*by, size).agg(F.count("*").alias("_n"))
    grouped = counted.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]) if rollup else counted.groupBy(*by)
    p = F.percentile(F.col(size), F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)]), F.col("_n"))
    total = F.sum(F.col(size) * F.col("_n"))
    out = grouped.agg(*([(F.grouping(by[0]) == 1).alias("is_rollup")] if rollup else []), F.sum("_n").cast("long").alias("object_count"), total.cast("long").alias("total_bytes"), (total / F.sum("_n")).alias("mean_bytes"), p.alias("_p"), F.min(size).cast("long").alias("min_bytes"), F.max(size).cast("long").alias("max_bytes"))
    return out.select("*", F.col("_p")[0].alias("median_bytes"), *[F.col("_p")[k].alias(f"p{q}_bytes") for k, q in enumerate((50, 90, 95, 99))]).drop("_p")


def power_of_two_bins(smallest: int, largest: int) -> list[int]:
    """Edges from the power of two at or below the smallest to the one above the largest."""
    low = max(smallest, 1).bit_length() - 1
    high = max(largest, 1).bit_length()
    return [1 << k for k in range(low, high + 1)]


def histogram(sizes: DataFrame, edges: Sequence[int] | None = None, size: str = "size") -> DataFrame:
    """(bin, low, high, n) of half-open bins; what lies outside falls into the end bins, and empty bins are there."""
    spark = sizes.sparkSession
    if edges is None:
        low, high = sizes.agg(F.min(size), F.max(size)).first()
        if low is None:
            raise ValueError("no objects")
        edges = power_of_two_bins(low, high)
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("bin edges must be two or more and increase")
    bins = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low long, high long")
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(size))) - 1
    counted = sizes.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(len(edges) - 2)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(counted), "bin", "left").fillna({"n": 0})


def tiers_fit(mean: Column, tiers=TIERS) -> Column:
    """Names of the tiers whose least size the whole-number part of the mean reaches, by rising size."""
    ordered = sorted(tiers, key=lambda t: t[1])
    return F.filter(F.array(*[F.when(F.floor(mean) >= least, F.lit(name)) for name, least in ordered]), lambda x: x.isNotNull())


def highest_tier(mean: Column, tiers=TIERS) -> Column:
    """The last tier that fits, or null."""
    return F.try_element_at(tiers_fit(mean, tiers), F.lit(-1))


def layout_digest(layouts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: how many objects of each kind, and what stands for the kind: tiled fraction, row groups, indexed fraction, nodes, shards."""
    kind = F.col("kind")
    return layouts.groupBy(*by).agg(
        F.count_if(kind == "raster").alias("rasters"),
        F.count_if((kind == "raster") & F.col("tiled")).alias("tiled"),
        F.sum(F.when(kind == "columnar", F.col("parts")).otherwise(0)).cast("long").alias("row_groups"),
        F.count_if((kind == "indexed") & F.col("indexed")).alias("with_index"),
        F.sum(F.when(kind == "octree", F.col("parts")).otherwise(0)).cast("long").alias("nodes"),
        F.sum(F.when(kind == "store", F.col("parts")).otherwise(0)).cast("long").alias("shards"),
    )
