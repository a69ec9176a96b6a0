"""A run over a set of products as one dataflow: the products that it is about, their object profiles, write figures and conditions, each product's and all products' from the same pass, and one report.

Inputs are tables of all products: objects (product, size), writes (product, elapsed,
bytes_out, bytes_in), and measurements (product, phase, cache, concurrency, replicate,
worker, component, metric, value, error).  All products' figures are worked out over the
pool of their rows by grouping sets, not from the products' figures.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions.uri import format_bytes
from quarry.operators import measure, profile, report
from quarry.operators.run import product_limit

ROLLUP = "rollup"
CONDITION = ("phase", "cache", "concurrency")


@dataclass(frozen=True)
class Plan:
    """What a run is about: one product, or the set of those with a prefix and a pattern up to a limit; the metrics that are asked for (none named: all), and of how many components of a product the reads are measured (nothing: all)."""

    scope: str = "product-set"
    prefix: str | None = None
    pattern: str | None = None
    limit: int | None = None
    metrics: Sequence[str] = ()
    samples: int | None = None
    tiers: Sequence[tuple[str, int]] = profile.TIERS

    def __post_init__(self):
        if self.scope not in ("product", "product-set"):
            raise ValueError(f"unknown scope {self.scope}; there are product and product-set")


@dataclass
class Run:
    """Records, a row for each product and one for all; and what was counted while they were written."""

    records: DataFrame
    observed: dict = field(default_factory=dict)


def chosen(objects: DataFrame, plan: Plan) -> DataFrame:
    """(product) that a run is about, the first by name up to its limit; none is an error."""
    out = objects.select("product").where("product is not null").distinct()
    if plan.prefix:
        out = out.where(F.col("product").startswith(plan.prefix))
    if plan.pattern:
        out = out.where(F.regexp_like("product", F.lit(plan.pattern)))
    limit = product_limit(plan.scope, plan.limit)
    if limit is not None:
        out = out.orderBy("product").limit(max(0, limit))
    if out.isEmpty():
        raise ValueError("no products" + (f" under prefix {plan.prefix!r}" if plan.prefix else "") + (f" matching {plan.pattern!r}" if plan.pattern else ""))
    return out


def _both(df: DataFrame, keys: Sequence[str] = ()):
    """Groups of products, and of all of them together, within keys."""
    own, all_of = [F.col("product"), *map(F.col, keys)], [F.col(k) for k in keys]
    return df.groupingSets([own, all_of], F.col("product"), *all_of)


def _name():
    """A product's name, and the empty one for all of them, to join by."""
    return F.coalesce(F.col("product"), F.lit(""))


def write_figures(writes: DataFrame) -> DataFrame:
    """(is_rollup, product, elapsed, bytes_out, bytes_in, components, throughput); rows that stand for several writes say so in ``components``."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double").alias(c)
    many = F.sum("components") if "components" in writes.columns else F.count("*")
    out = _both(writes).agg((F.grouping("product") == 1).alias("is_rollup"), exact("elapsed"), exact("bytes_out"), exact("bytes_in"), many.cast("long").alias("components"))
    return out.withColumn("throughput", measure.throughput(F.col("bytes_out"), F.col("elapsed")))


def sampled(measured: DataFrame, samples: int | None) -> DataFrame:
    """Measurements of the first components of each product, by their number; all without a limit."""
    return measured if samples is None else measured.where(F.col("component") < samples)


def condition_figures(measured: DataFrame) -> DataFrame:
    """(is_rollup, product, phase, cache, concurrency, metric, mean, median, spread, replicates, error): a replicate is the mean of its workers, and all products' figures are over all their replicates.

    A condition that was skipped for a product adds none; where it was skipped for all, its row has no figures but the error.
    """
    there = measured.withColumn("value", F.when(F.col("error").isNull(), F.col("value")))
    merged = there.groupBy("product", *CONDITION, "component", "replicate", "metric").agg(F.avg("value").alias("value"), F.max("error").alias("error"))
    statistics = [F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("spread"), F.count("value").alias("replicates"), F.max("error").alias("error")]
    out = _both(merged, [*CONDITION, "metric"]).agg((F.grouping("product") == 1).alias("is_rollup"), *statistics)
    return out.select("is_rollup", "product", *CONDITION, "metric", "mean", "median", "spread", "replicates", F.when(F.col("replicates") == 0, F.col("error")).alias("error"))


def product_run(objects: DataFrame, writes: DataFrame, measured: DataFrame, plan: Plan | None = None) -> Run:
    """Records of a run: (is_rollup, product, products, object profile, tiers, highest_tier, write, conditions).

    ``conditions`` is a list in order, as long as the protocol has conditions and metrics;
    ``write`` is null where a product has no writes.
    """
    plan = plan or Plan()
    products = chosen(objects, plan)
    # The products are few beside their objects; Catalyst broadcasts them as far as their size lets it.
    objects, writes, measured = (df.join(products, "product", "left_semi") for df in (profile.validated(objects), writes, measured))
    sizes = profile.size_profile(objects, ["product"], rollup=True)
    sizes = sizes.withColumns({"tiers": profile.tiers_fit(F.col("mean_bytes"), plan.tiers), "highest_tier": profile.highest_tier(F.col("mean_bytes"), plan.tiers)})
    conditions = condition_figures(sampled(measured, plan.samples))
    if plan.metrics:
        conditions = conditions.where(F.col("metric").isin(list(plan.metrics)))
    told = [c for c in conditions.columns if c not in ("is_rollup", "product")]
    listed = conditions.groupBy("is_rollup", _name().alias("_name")).agg(F.array_sort(F.collect_list(F.struct(*told))).alias("conditions"))
    figures = write_figures(writes)
    figures = figures.select("is_rollup", _name().alias("_name"), F.struct(*[c for c in figures.columns if c not in ("is_rollup", "product")]).alias("write"))
    out = sizes.withColumn("_name", _name()).join(figures, ["is_rollup", "_name"], "left").join(listed, ["is_rollup", "_name"], "left")
    count = products.agg(F.count("*").alias("products"))
    out = out.crossJoin(count).drop("_name")  # one row
    whole = [c for c in sizes.columns if c not in ("is_rollup", "product")]
    return Run(out.select("is_rollup", "product", F.when(F.col("is_rollup"), F.col("products")).otherwise(F.lit(1)).cast("long").alias("products"), *whole, "write", F.coalesce("conditions", F.array().cast(listed.schema["conditions"].dataType)).alias("conditions")))


def figures(run: Run) -> DataFrame:
    """Every figure of a run as a row: (is_rollup, product, section, name, value)."""
    number = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    flat = [number("profile", F.lit(c), F.col(c)) for c in ("object_count", "total_bytes", "mean_bytes", "min_bytes", "max_bytes", "median_bytes", "p90_bytes", "p95_bytes", "p99_bytes")]
    flat += [number("write", F.lit(c), F.col(f"write.{c}")) for c in ("elapsed", "bytes_out", "bytes_in", "components", "throughput")]
    flat += [number("run", F.lit("products"), F.col("products")), number("run", F.concat(F.lit("tier:"), F.coalesce("highest_tier", F.lit("none"))), F.size("tiers"))]
    named = lambda c, what: F.concat_ws("/", c["phase"], c["cache"], c["concurrency"].cast("string"), c["metric"], F.lit(what))
    of = lambda what: F.transform("conditions", lambda c: number("condition", named(c, what), c[what]))
    each = [of(what) for what in ("mean", "median", "spread", "replicates")]
    rows = run.records.select("is_rollup", "product", F.explode(F.concat(F.array(*flat), *each)).alias("f"))
    return rows.select("is_rollup", "product", "f.*").where("value is not null")


def summary(run: Run, title: str = "Products") -> DataFrame:
    """(line_no, line) of one report: a table of the products and the roll-up, then the roll-up's conditions."""
    told = run.records.select("*", F.posexplode_outer(F.when(F.col("is_rollup"), F.col("conditions"))).alias("at", "c")).where("c is not null")
    conditions = told.select("c.*")
    head = report.markdown(report.product_rows(run.records), title, ["product", "objects", "total", "mean", "p95"])
    tail = report.markdown(report.condition_rows(conditions.where("replicates > 0")), "Conditions over all products", ["phase", "cache", "run", "metric", "replicates", "mean", "spread"])
    skipped = conditions.where("replicates = 0").select(F.struct(*CONDITION, "metric").alias("place"), F.format_string("| %s | %s | %d | %s |", "phase", "cache", "concurrency", F.coalesce("error", F.lit(""))).alias("line"))
    return report.document([head, tail, report.markdown(skipped, "Skipped", ["phase", "cache", "concurrency", "reason"])])


def write_run(run: Run, path: str) -> Run:
    """Records as JSON below ``records``, a folder for each product and one for the roll-up, and the report in ``summary``; the run with what was counted on the way."""
    seen = Observation("run")
    named = run.records.withColumn("run", F.when(F.col("is_rollup"), ROLLUP).otherwise(F.concat(F.lit("product-"), "product")))
    told = named.observe(seen, F.count_if(~F.col("is_rollup")).alias("products"), F.coalesce(F.sum(F.when(~F.col("is_rollup"), F.col("object_count"))), F.lit(0)).alias("objects"), F.coalesce(F.sum(F.when(~F.col("is_rollup"), F.col("total_bytes"))), F.lit(0)).alias("bytes"))
    told.write.partitionBy("run").mode("overwrite").json(f"{path}/records")
    lines = summary(run)
    # A report has a row for each product and condition.
    lines.repartitionByRange(1, "part", "line_no").sortWithinPartitions("part", "line_no").select("line").write.mode("overwrite").text(f"{path}/summary")
    return Run(run.records, dict(seen.get))


def size_line(run: Run) -> str:
    """One line about a run that was written."""
    shown = run.records.sparkSession.range(1).select(format_bytes(F.lit(int(run.observed["bytes"]))).alias("b")).first().b
    return f"{run.observed['products']} products, {run.observed['objects']} objects, {shown}"
