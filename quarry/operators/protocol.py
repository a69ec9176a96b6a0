"""Timed runs of Spark actions under a protocol: cold or warm, one or several at once, replicated; the results are rows.

Cold runs clear Spark's cache and read anew; that is not a fresh interpreter, and
results say so by their cache column alone.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURED = "phase string, cache string, concurrency int, replicate int, worker int, metric string, value double, error string"


@dataclass(frozen=True)
class Condition:
    cache: str = "warm"
    concurrency: int = 1

    def __post_init__(self):
        if self.cache not in ("cold", "warm") or self.concurrency < 1:
            raise ValueError(f"not a condition: {self}")


def parse_protocol(params: dict | None) -> tuple[int, list[Condition]]:
    """(replicates, conditions); once and warm, one at a time, where nothing is said."""
    params = params or {}
    replicates = int(params.get("replicates", 1))
    if replicates < 1:
        raise ValueError("replicates must be 1 or more")
    conditions = [Condition(str(c.get("cache", "warm")), int(c.get("concurrency", 1))) for c in params.get("conditions", [{}])]
    return replicates, conditions or [Condition()]


def together(spark: SparkSession, action: Callable[[int], object], seeds: list[int], tag: str) -> list[float]:
    """Seconds of one worker for each seed, all at once: each runs its jobs in a pool of its own, so that none waits behind another where spark.scheduler.mode is FAIR.

    When one fails, the jobs of all are cancelled by their tag, and its error is raised.
    """
    context = spark.sparkContext

    def worker(number: int, seed: int) -> float:
        context.addJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", f"worker-{number}")
        try:
            began = time.perf_counter()
            action(seed)
            return time.perf_counter() - began
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            context.removeJobTag(tag)

    with ThreadPoolExecutor(len(seeds)) as pool:
        runs = [pool.submit(worker, w, s) for w, s in enumerate(seeds)]
        done, others = wait(runs, return_when=FIRST_EXCEPTION)
        failed = next((r.exception() for r in runs if r in done and r.exception()), None)
        if failed:
            # A worker between two jobs starts another one, so they are cancelled until all are done.
            while others:
                context.cancelJobsWithTag(tag)
                _, others = wait(others, timeout=0.1)
            raise failed
        return [r.result() for r in runs]


def measure(spark: SparkSession, action: Callable[[int], object], phase: str, replicates: int, conditions: list[Condition], seed: int = 0) -> DataFrame:
    """One row for each worker's run: its seconds.

    ``action`` takes a seed and does its work in Spark; the workers of a replicate run at
    once.  A warm condition has an untimed round first, a cold one clears the cache before
    each replicate.  A condition that fails gives one ``<phase>_condition_skipped`` row with
    the error, its other workers are cancelled, and the other conditions go on.
    """
    rows = []
    for c in conditions:
        tag = f"{phase}-{uuid.uuid4().hex}"
        try:
            mine = []
            if c.cache == "warm":
                together(spark, action, [seed - c.concurrency + w for w in range(c.concurrency)], tag)
            for r in range(replicates):
                if c.cache == "cold":
                    spark.catalog.clearCache()
                values = together(spark, action, [seed + r * c.concurrency + w for w in range(c.concurrency)], tag)
                mine += [(phase, c.cache, c.concurrency, r, w, f"{phase}_seconds", v, None) for w, v in enumerate(values)]
            rows += mine
        except Exception as e:  # noqa: BLE001  a condition is measured as well as may be
            rows.append((phase, c.cache, c.concurrency, 0, 0, f"{phase}_condition_skipped", None, str(e)[:300]))
    return spark.createDataFrame(rows, MEASURED)


def run_conditions(spark: SparkSession, sampled: dict[str, Callable[[int], object]], phase: str, params: dict | None, seed: int = 0) -> DataFrame:
    """Measured rows of several components (their names and what to read of each) under one protocol, with a column ``component``; a display is always warm and alone."""
    replicates, conditions = parse_protocol(params)
    if phase == "display":
        conditions = [Condition()]
    out = None
    for name, action in sampled.items():
        one = measure(spark, action, phase, replicates, conditions, seed).withColumn("component", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], MEASURED + ", component string")


def random_windows(rows: int, cols: int, side: int, count: int, seed: int, block: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Windows (number, row, col, height, width) inside a raster from a seeded generator, column first.

    With the (rows, cols) of its blocks, even windows begin where a block does and odd
    ones don't, as far as the raster's edge lets them.
    """
    rng = random.Random(seed)
    h, w = min(side, rows), min(side, cols)

    def origin(k: int, drawn: int, last: int, step: int) -> int:
        off = drawn % step if step > 0 else 0
        if k % 2 == 0:
            return min(drawn - off, last)
        return min(drawn + step // 2, last) if step > 1 and off == 0 else drawn

    out = []
    for k in range(count):
        col, row = rng.randint(0, cols - w), rng.randint(0, rows - h)
        if block:
            col, row = origin(k, col, cols - w, block[1]), origin(k, row, rows - h, block[0])
        out.append((k, row, col, h, w))
    return out


def random_boxes(box: tuple[float, float, float, float], count: int, seed: int) -> list[tuple[int, float, float, float, float]]:
    """Boxes (number, x0, y0, x1, y1) of the extent over the root of their number, at random places inside it."""
    rng = random.Random(seed)
    parts = max(1, -(-(count**0.5) // 1))
    dx, dy = ((box[2] - box[0]) / parts or 1.0), ((box[3] - box[1]) / parts or 1.0)
    out = []
    for k in range(count):
        x = rng.uniform(box[0], max(box[0], box[2] - dx))
        y = rng.uniform(box[1], max(box[1], box[3] - dy))
        out.append((k, x, y, x + dx, y + dy))
    return out


def capabilities(spark: SparkSession) -> DataFrame:
    """(capability, present, detail) of what readers and writers need."""
    import importlib.util

    rows = [("spark", True, spark.version)]
    for name in ("pyarrow", "pandas", "numpy", "yaml"):
        rows.append((name, importlib.util.find_spec(name) is not None, ""))
    return spark.createDataFrame(rows, "capability string, present boolean, detail string")


def random_cubes(extent: tuple[float, float, float, float, float, float], count: int, seed: int) -> list[tuple[int, float, float, float, float, float, float]]:
    """Boxes (number, x0, y0, z0, x1, y1, z1) over the full height of an extent (x0, y0, z0, x1, y1, z1), at the places of ``random_boxes``."""
    flat = random_boxes((extent[0], extent[1], extent[3], extent[4]), count, seed)
    return [(k, x0, y0, extent[2], x1, y1, extent[5]) for k, x0, y0, x1, y1 in flat]
