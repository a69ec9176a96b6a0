"""Reports: Markdown and JSON of profiles and conditions, made as text columns and put together in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.uri import format_bytes
from quarry.operators.order import numbered
from quarry.operators.profile import tiers_fit


def product_rows(profiles: DataFrame) -> DataFrame:
    """(place, line): a table row for each product of a rolled-up profile, the roll-up last and in bold."""
    name = F.when(F.col("is_rollup"), F.lit("**all products**")).otherwise(F.col("product"))
    line = F.format_string("| %s | %d | %s | %s | %s |", name, "object_count", format_bytes(F.col("total_bytes")), format_bytes(F.col("mean_bytes").cast("long")), format_bytes(F.col("p95_bytes").cast("long")))
    return profiles.select(F.struct("is_rollup", "product").alias("place"), line.alias("line"))


def condition_rows(statistics: DataFrame) -> DataFrame:
    """(place, line) for each phase, cache, concurrency and metric."""
    how = F.when(F.col("concurrency") == 1, F.lit("isolated")).otherwise(F.format_string("concurrent (%d)", "concurrency"))
    line = F.format_string("| %s | %s | %s | %s | %d | %.6f | %.6f |", "phase", "cache", how, "metric", "replicates", F.bround("mean", 6), F.bround("spread", 6))
    return statistics.select(F.struct("phase", "cache", "concurrency", "metric").alias("place"), line.alias("line"))


def layout_rows(layouts: DataFrame) -> DataFrame:
    """(place, line) of object layouts (name, kind, size, parts, tiled, indexed, overview_bytes): what its kind is told by, and shares of overviews or indexes."""
    share = F.when(F.col("size") > 0, F.format_string("%.1f %%", F.bround(100 * F.col("overview_bytes") / F.col("size"), 1))).otherwise(F.lit("-"))
    what = (
        F.when(F.col("kind") == "raster", F.when(F.col("tiled"), F.lit("tiled")).otherwise(F.lit("striped")))
        .when(F.col("kind") == "columnar", F.format_string("%d row groups", "parts"))
        .when(F.col("kind") == "indexed", F.when(F.col("indexed"), F.concat(F.lit("indexed, index "), share)).otherwise(F.lit("without index")))
        .when(F.col("kind") == "octree", F.format_string("%d nodes", "parts"))
        .when(F.col("kind") == "store", F.concat(F.format_string("%d shards, overviews ", "parts"), share))
        .otherwise(F.lit("-"))
    )
    return layouts.select(F.struct("kind", "name").alias("place"), F.format_string("| %s | %s | %s | %s |", "name", "kind", format_bytes(F.col("size")), what).alias("line"))


def artifact_rows(artifacts: DataFrame) -> DataFrame:
    """(place, line) of artifacts (name, uri, reason): where each is, or why there is none."""
    line = F.when(F.col("uri").isNotNull(), F.format_string("* %s: %s", "name", "uri")).otherwise(F.format_string("* %s: skipped (%s)", F.col("name"), F.coalesce("reason", F.lit("no reason given"))))
    return artifacts.select("name", line.alias("line")).select(F.struct("name").alias("place"), "line")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(place, line) of metrics (metric, value, unit)."""
    return metrics.select(F.struct("metric").alias("place"), F.format_string("| %s | %.6g | %s |", F.col("metric"), F.col("value"), F.coalesce("unit", F.lit(""))).alias("line"))


def profile_rows(profile: DataFrame) -> DataFrame:
    """(place, line) of one profile: what it counts, its sizes, and the tiers that its mean reaches."""
    shown = lambda *names: F.concat_ws(" / ", *[format_bytes(F.col(f"{n}_bytes").cast("long")) for n in names])
    said = [("Objects", F.col("object_count").cast("string")), ("Total", shown("total")), ("Mean", shown("mean")), ("Median / p90 / p99", shown("median", "p90", "p99")), ("Min / max", shown("min", "max")), ("Tiers", F.coalesce(F.nullif(F.array_join(tiers_fit(F.col("mean_bytes")), ", "), F.lit("")), F.lit("none")))]
    lines = F.array(*[F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in said])
    return profile.select(F.posexplode(lines).alias("k", "line")).select(F.struct("k").alias("place"), "line")


def document(parts: list[DataFrame]) -> DataFrame:
    """Sections (line_no, line) one after another: (part, line_no, line), to be read in that order."""
    out = None
    for k, part in enumerate(parts):
        one = part.select(F.lit(k).alias("part"), "line_no", "line")
        out = one if out is None else out.unionByName(one)
    return out


def summary(layout: str, where: str, profile: DataFrame, metrics: DataFrame, *more: DataFrame) -> DataFrame:
    """Summary of a run: what was written where, its profile, its metrics, and further sections."""
    head = profile.sparkSession.createDataFrame([(0, f"# {layout}"), (1, ""), (2, f"Written to `{where}`"), (3, "")], "line_no int, line string")
    return document([head, markdown(profile_rows(profile), "Object sizes", ["what", "value"]), markdown(metric_rows(metrics), "Metrics", ["metric", "value", "unit"]), *more])


def write_product_set(lines: DataFrame, path: str) -> None:
    """Lines (product, part, line_no, line) of many products: a folder for each, its lines in order; the roll-up has the product ``rollup``."""
    lines.repartition("product").sortWithinPartitions("product", "part", "line_no").select("product", "line").write.partitionBy("product").mode("overwrite").text(path)


def markdown(rows: DataFrame, title: str, header: list[str]) -> DataFrame:
    """(line_no, line) of a section; rows (place, line) are one each of products or conditions, numbered by ranges."""
    top = [f"## {title}", "", "| " + " | ".join(header) + " |", "|" + " --- |" * len(header)]
    head = rows.sparkSession.createDataFrame([(k, x) for k, x in enumerate(top)], "line_no int, line string")
    body = numbered(rows.select("place", "line"), ["place", "line"], name="at").select((F.col("at") + len(top)).cast("int").alias("line_no"), "line")
    return head.unionByName(body)


def write_report(lines: DataFrame, result: DataFrame, path: str) -> None:
    """``summary`` (text, in order) and ``result`` (JSON lines) below a folder."""
    lines.repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{path}/summary")
    result.write.mode("overwrite").json(f"{path}/result")
