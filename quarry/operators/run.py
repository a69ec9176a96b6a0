"""Runs: a table written in a layout, timed, and told about in rows: objects, profile, metrics, report."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import profile, report
from quarry.sources.listing import list_objects
from quarry.sources.options import options_of
from quarry.sources.registry import layouts

METRICS = "metric string, value double, unit string"


def product_limit(scope: str, limit: int | None) -> int | None:
    """How many products a run takes: one where it is about one and no number is given."""
    return 1 if limit is None and scope == "product" else limit


def requested(metrics: DataFrame, names: list[str] | None) -> DataFrame:
    """The metrics asked for; all where none is named."""
    return metrics.where(F.col("metric").isin(names)) if names else metrics


def timed_write(df: DataFrame, layout: str, path: str, given: Mapping | None = None, bytes_in: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, metrics) of a table written below a folder: seconds, bytes out, throughput, and bytes in where they are known."""
    import quarry.sources.stored  # noqa: F401  further layouts register there

    own = layouts.get(layout)
    options = options_of(own.options, given)
    began = time.perf_counter()
    own.write(df, path, options)
    took = time.perf_counter() - began
    spark = df.sparkSession
    # Files with a leading underscore or dot are Spark's own marks.
    objects = list_objects(spark, path).where(~F.regexp_like("key", F.lit(r"(^|/)[_.][^/]*$")))
    out = objects.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = [("write_seconds", took, "s"), ("bytes_out", float(out), "B"), ("write_throughput", out / took if took > 0 else float("inf"), "B/s")]
    return objects, spark.createDataFrame(rows + ([("bytes_in", float(bytes_in), "B")] if bytes_in is not None else []), METRICS)


def conversion(df: DataFrame, layout: str, path: str, given: Mapping | None = None, bytes_in: int | None = None, metrics: list[str] | None = None) -> dict[str, DataFrame]:
    """A written layout and what there is to tell about it: objects, profile, layout, records of it, metrics, lines of the summary."""
    objects, measured = timed_write(df, layout, path, given, bytes_in)
    measured = requested(measured, metrics)
    sizes = profile.size_profile(objects)
    return {"objects": objects, "profile": sizes, "layout": layouts.get(layout).describe(df.sparkSession, path), "records": layouts.get(layout).records(df.sparkSession, path), "metrics": measured, "summary": report.summary(layout, path, sizes, measured)}


def assemble_conditions(measured: DataFrame) -> DataFrame:
    """(phase, cache, concurrency, replicates, error) of measured rows: per replicate a map of metrics, each the mean over its workers; a skipped condition has none, and its error.

    A condition has as many entries as the protocol has replicates and metrics.
    """
    how = ["phase", "cache", "concurrency"]
    means = measured.where("error is null").groupBy(*how, "replicate", "metric").agg(F.avg("value").alias("value"))
    each = means.groupBy(*how, "replicate").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    done = each.groupBy(*how).agg(F.sort_array(F.collect_list(F.struct("replicate", F.map_entries("metrics").alias("metrics")))).alias("replicates"))
    failed = measured.groupBy(*how).agg(F.max("error").alias("error"))
    return failed.join(done, how, "left").select(*how, F.coalesce("replicates", F.array()).alias("replicates"), "error")

