"""Pyramids of several rasters in one ladder of levels.

A bundle is a table of grids, a row for each component with its pixel size and shape.
Its ladder is a table as well, a row for each component and level, made by column
expressions for all bundles at once; steps that can't be are found by one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.grid import auto_depth

#: A ratio this near to a whole number is one.
NEAR = 1e-6
#: A table of more rows isn't broadcast.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table with the hint to broadcast it, if it has no more than so many rows; else a join shuffles it, and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _whole(ratio: Column) -> Column:
    return F.rint(ratio).cast("long")


def bundle_steps(grids: DataFrame, levels: Sequence[float] | int | str | None = "auto", by: Sequence[str] = (), least: int = 256) -> DataFrame:
    """(by, finest, own, steps): the pixel sizes of each bundle, and of its ladder, over its finest one.

    ``levels`` are pixel sizes above the finest one, or halvings beyond the coarsest own
    size: a number, or as many as leave its shorter side ``least`` cells.
    """
    side = F.least("rows", "cols")
    each = grids.groupBy(*by).agg(F.min("pixel").alias("finest"), F.array_sort(F.collect_set("pixel")).alias("pixels"), F.max_by(side, F.struct(F.col("pixel"), -side)).alias("side"))
    each = each.withColumn("own", F.transform("pixels", lambda p: p / F.col("finest")))
    if isinstance(levels, (list, tuple)) and levels:
        steps = F.concat(F.array(F.lit(1.0)), F.transform(F.array(*[F.lit(float(x)) for x in levels]), lambda p: p / F.col("finest")))
    else:
        depth = auto_depth(F.col("side"), F.col("side"), least) if levels is None or isinstance(levels, (str, list, tuple)) else F.lit(max(0, int(levels)))
        last = F.element_at("own", -1)
        steps = F.concat("own", F.transform(F.filter(F.sequence(F.lit(0), depth), lambda k: k > 0), lambda k: last * F.pow(F.lit(2.0), k)))
    return each.select(*by, "finest", "own", steps.alias("steps"))


def faults(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, problem, ratio) of steps that no ladder can have: ratios that aren't whole, don't grow, don't divide the next one, or own sizes that are no step."""
    off = lambda r: F.abs(r - F.rint(r)) > NEAR
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("steps") - 1)), lambda k: F.struct(F.get("steps", k - 1).alias("a"), F.get("steps", k).alias("b")))
    named = lambda problem, ratios: F.transform(ratios, lambda r: F.struct(F.lit(problem).alias("problem"), r.alias("ratio")))
    upper = lambda keep: F.transform(F.filter(pairs, lambda p: p["b"].isNotNull() & keep(p["a"], p["b"])), lambda p: p["b"])
    found = F.concat(
        named("not a whole multiple of the finest size", F.filter(F.array_union("own", "steps"), off)),
        named("not larger than the level before", upper(lambda a, b: _whole(b) <= _whole(a))),
        named("not a whole multiple of the level before", upper(lambda a, b: ~off(a) & ~off(b) & (_whole(b) > _whole(a)) & (_whole(b) % _whole(a) != 0))),
        named("an own size that is not among the levels", F.filter("own", lambda o: ~F.exists("steps", lambda s: F.abs(s - o) <= NEAR))),
    )
    return steps.select(*by, F.explode(found).alias("f")).select(*by, "f.problem", "f.ratio")


def ladder(grids: DataFrame, levels: Sequence[float] | int | str | None = "auto", by: Sequence[str] = (), component: str = "component", least: int = 256) -> DataFrame:
    """(by, component, level, decimation, factor, native, rows, cols), from each component's own level to the coarsest that has a cell.

    ``decimation`` is against the bundle's finest size, ``factor`` against the component's
    level before.  A bundle whose steps can't be is an error that names them.
    """
    steps = bundle_steps(grids, levels, by, least)
    if wrong := faults(steps, by).limit(5).collect():
        raise ValueError("; ".join(f"{r.problem}: {r.ratio}" + "".join(f", {c} {r[c]}" for c in by) for r in wrong))
    steps = small(steps)
    both = grids.join(steps, list(by)) if by else grids.crossJoin(steps)  # one row, if there is a single bundle
    own = _whole(F.col("pixel") / F.col("finest"))
    each = both.select(*by, component, "rows", "cols", own.alias("_own"), "steps", F.posexplode(F.transform("steps", _whole)).alias("level", "decimation")).where(F.col("decimation") >= F.col("_own"))
    before = F.when(F.col("decimation") > F.col("_own"), F.col("decimation") / _whole(F.get("steps", F.col("level") - 1)))
    shape = {c: F.expr(f"{c} div (decimation div _own)") for c in ("rows", "cols")}
    made = each.select(*by, component, "level", "decimation", F.coalesce(before, F.lit(1.0)).cast("long").alias("factor"), (F.col("decimation") == F.col("_own")).alias("native"), *[v.alias(c) for c, v in shape.items()])
    return made.where((F.col("rows") > 0) & (F.col("cols") > 0))


def unified_pyramid(cells: DataFrame, levels: DataFrame, keys: Sequence[str] = ("component",), fill: float | None = None, integer: bool = False, cut=None) -> DataFrame:
    """(keys, level, row, col, value): each component from its own level to the coarsest, every level from the one before it.

    Cells are (keys, row, col, value) of all components at their own levels; ``levels`` is
    their ladder.  A value is the mean over cells that aren't fill, all fill gives fill, a
    ragged edge is left out, and whole-number types are cut towards zero.  Each level is
    written by ``cut`` (a function of DataFrame and name), so that none is made twice.
    """
    if cut is None:
        from quarry.plans.tables import written as cut
    levels = cut(levels, "ladder")
    there = [(r.level, r.native) for r in levels.groupBy("level").agg(F.max("native").alias("native")).orderBy("level").collect()]
    value = F.col("value") if fill is None else F.when(F.col("value") != fill, F.col("value"))
    mean = F.avg(value) if fill is None else F.coalesce(F.avg(value), F.lit(fill))
    mean = mean.cast("long").cast("double") if integer else mean
    out = below = None
    for level, native in there:
        at = levels.where(F.col("level") == level).drop("level")
        here = cells.join(small(at.where("native").select(*keys)), list(keys), "left_semi").select(*keys, F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double")) if native else None
        if below is not None:
            step = small(at.where("not native").select(*keys, "factor", F.col("rows").alias("_rows"), F.col("cols").alias("_cols")))
            inside = below.join(step, list(keys)).where((F.col("row") < F.col("_rows") * F.col("factor")) & (F.col("col") < F.col("_cols") * F.col("factor")))
            made = inside.groupBy(*keys, F.expr("row div factor").alias("row"), F.expr("col div factor").alias("col")).agg(mean.alias("value"))
            here = made if here is None else here.unionByName(made)
        below = cut(here, f"level-{level}")
        one = below.select(*keys, F.lit(level).alias("level"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return cells.select(*keys, F.lit(0).alias("level"), "row", "col", "value").limit(0)
    return out
