"""Records of how objects are laid out, of all kinds in one table, and a table of each kind for the report.

A record has what every kind has in columns (name, kind, size, codec, ratio) and what only
its kind has in a VARIANT, ``details``: kinds are added without a new column, and a detail
is read by its name where it is there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.uri import format_bytes

#: What only one kind has, by kind.
DETAILS = {
    "raster": "tiled boolean, block_rows int, block_cols int, overviews int, tiles long, bands array<string>",
    "store": "chunk array<int>, shard array<int>, levels int, shards long, native_level int, overview_bytes long, stored string, unscaled boolean, grid string",
    "columnar": "geometry string, features long, row_groups long, group_rows long, covering boolean",
    "indexed": "geometry string, features long, dropped long, made long, placed long, indexed boolean, node_size int, index_bytes long",
    "octree": "nodes long, depth int, points long, node_points long, carried array<string>",
}
COMMON = ("name", "kind", "size", "codec", "ratio")
_KINDS = tuple(DETAILS)


def records(described: DataFrame, kind: str) -> DataFrame:
    """(name, kind, size, codec, ratio, details) of objects of one kind from columns of these names; a detail that has no column isn't told."""
    if kind not in DETAILS:
        raise ValueError(f"unknown kind {kind}; there are {', '.join(_KINDS)}")
    wanted = dict(x.strip().split(" ") for x in DETAILS[kind].split(","))
    there = [F.col(c).cast(t).alias(c) for c, t in wanted.items() if c in described.columns]
    if not there:
        raise ValueError(f"nothing is told about objects of kind {kind}; there may be {', '.join(wanted)}")
    known = lambda c, t: (F.col(c) if c in described.columns else F.lit(None)).cast(t).alias(c)
    return described.select(F.col("name").cast("string").alias("name"), F.lit(kind).alias("kind"), F.col("size").cast("long").alias("size"), known("codec", "string"), known("ratio", "double"), F.to_variant_object(F.struct(*there)).alias("details"))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """Records of several kinds, by name: a table may lack a column or have further ones of its own."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no records")
    return out


def detail(name: str, kind: str) -> Column:
    """A detail of a record; null where the record has none of this name, or not as this type."""
    return F.try_variant_get("details", f"$.{name}", kind)


@dataclass(frozen=True)
class Table:
    """How a kind is told: a title, header and cells, the sums over its records by name, and lines made from these."""

    title: str
    header: Sequence[str]
    cells: Callable[[], list[Column]]
    sums: Callable[[], dict[str, Column]]
    lines: Callable[[], list[Column]]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _yes(name: str) -> Column:
    return F.when(detail(name, "boolean"), "yes").otherwise("no")


def _by(names: str) -> Column:
    return F.array_join(detail(names, "array<int>").cast("array<string>"), "x")


def _listed(name: str) -> Column:
    got = detail(name, "array<string>")
    return F.when(F.size(got) > 0, F.array_join(got, ", ")).otherwise("-")


def _total(name: str) -> Column:
    return F.coalesce(F.sum(detail(name, "long")), F.lit(0))


def _share(part: str, whole: str = "bytes") -> Column:
    """Percentage of one sum in another, ``-`` of nothing."""
    return F.when(F.col(whole) > 0, F.format_string("%.1f %%", F.bround(100 * F.col(part) / F.col(whole), 1))).otherwise("-")


def _raster() -> list[Column]:
    return [_yes("tiled"), F.concat_ws("x", detail("block_rows", "string"), detail("block_cols", "string")), _text(detail("overviews", "int")), _text(detail("tiles", "long")), _listed("bands")]


def _store() -> list[Column]:
    chunk, shard = detail("chunk", "array<int>"), detail("shard", "array<int>")
    # Chunks of a shard along each axis, at least one.
    per = F.aggregate(F.zip_with(shard, chunk, lambda s, c: F.greatest(F.lit(1), F.floor(s / c))), F.lit(1).cast("long"), lambda a, x: a * x)
    native, levels = detail("native_level", "int"), detail("levels", "int")
    told = F.when(native.isNull(), "-").when(levels > 0, F.concat(native.cast("string"), F.lit(" native, "), (native + 1).cast("string"), F.lit(" to "), (native + levels).cast("string"), F.lit(" derived"))).otherwise(F.concat(native.cast("string"), F.lit(" native")))
    stored = detail("stored", "string")
    encoding = F.when(detail("unscaled", "boolean"), F.concat_ws(" as ", F.lit("unscaled by readers"), stored)).otherwise(_text(stored))
    return [_by("chunk"), _by("shard"), _text(per), _text(levels), _text(detail("shards", "long")), encoding, _text(detail("grid", "string")), told]


def _columnar() -> list[Column]:
    return [_text(detail("geometry", "string")), *[_text(detail(c, "long")) for c in ("features", "row_groups", "group_rows")], _yes("covering")]


def _indexed() -> list[Column]:
    index = detail("index_bytes", "long")
    return [_text(detail("geometry", "string")), *[_text(detail(c, "long")) for c in ("features", "dropped", "made", "placed")], _yes("indexed"), _text(detail("node_size", "int")), format_bytes(F.coalesce(index, F.lit(0).cast("long"))), format_bytes(F.col("size") - F.coalesce(index, F.lit(0).cast("long")))]


def _octree() -> list[Column]:
    return [*[_text(detail(c, "long")) for c in ("nodes", "depth", "points", "node_points")], F.greatest(F.lit(0), F.size(detail("carried", "array<string>"))).cast("string")]



def _only(when: Column, line: Column) -> Column:
    """A line that there may not be."""
    return F.when(when, line)


TABLES = {
    "raster": Table(
        "Tiling",
        ("tiled", "block", "overviews", "tiles", "bands"),
        _raster,
        lambda: {"n": F.count("*"), "tiled": F.count_if(detail("tiled", "boolean")), "several": F.count_if(F.size(detail("bands", "array<string>")) > 0)},
        lambda: [F.format_string("* %d of %d objects are tiled, %d in strips", "tiled", "n", F.col("n") - F.col("tiled")), _only(F.col("several") > 0, F.format_string("* %d objects hold several components, a band each", "several"))],
    ),
    "store": Table(
        "Chunks and shards",
        ("chunk", "shard", "chunks a shard", "levels", "shards", "values", "grid", "levels' origin"),
        _store,
        lambda: {"n": F.count("*"), "shards": _total("shards"), "grids": F.count_distinct(detail("grid", "string")), "overviews": _total("overview_bytes"), "bytes": F.coalesce(F.sum("size"), F.lit(0)), "flat": F.count_if(detail("levels", "int") == 0), "unscaled": F.count_if(detail("unscaled", "boolean"))},
        lambda: [
            F.format_string("* %d shards in %d arrays", "shards", "n"),
            _only(F.col("grids") > 0, F.format_string("* %d arrays share %d grids", "n", "grids")),
            F.when(F.col("overviews") > 0, F.concat(F.lit("* Overviews are "), format_bytes(F.col("overviews")), F.lit(" of "), format_bytes(F.col("bytes")), F.lit(", "), _share("overviews"))).when(F.col("flat") > 0, "* Without overviews: far views read full-resolution chunks"),
            _only(F.col("unscaled") > 0, F.format_string("* %d arrays are scaled by their own codec", "unscaled")),
        ],
    ),
    "columnar": Table(
        "Row groups",
        ("geometry", "features", "row groups", "rows a group", "covering"),
        _columnar,
        lambda: {"n": F.count("*"), "covering": F.count_if(detail("covering", "boolean"))},
        lambda: [F.format_string("* %d of %d files have boxes by which row groups are skipped", "covering", "n")],
    ),
    "indexed": Table(
        "Spatial index",
        ("geometry", "features", "dropped", "made", "placed", "indexed", "node size", "index", "features' bytes"),
        _indexed,
        lambda: {"n": F.count("*"), "indexed": F.count_if(detail("indexed", "boolean")), "index": _total("index_bytes"), "bytes": F.coalesce(F.sum("size"), F.lit(0)), **{c: _total(c) for c in ("dropped", "made", "placed")}, **{f"{c}_files": F.count_if(detail(c, "long") > 0) for c in ("dropped", "made", "placed")}},
        lambda: [
            F.format_string("* %d of %d files have an index", "indexed", "n"),
            F.concat(F.lit("* Indexes are "), format_bytes(F.col("index")), F.lit(", "), _share("index")),
            _only(F.col("dropped_files") > 0, F.format_string("* %d files lack %d features without geometry, so they aren't the whole source", "dropped_files", "dropped")),
            _only(F.col("made_files") > 0, F.format_string("* %d files have %d geometries made from columns", "made_files", "made")),
            _only(F.col("placed_files") > 0, F.format_string("* %d files have %d geometries that only hold a place", "placed_files", "placed")),
        ],
    ),
    "octree": Table(
        "Octree",
        ("nodes", "depth", "points", "points of a node", "carried"),
        _octree,
        lambda: {"n": F.count("*"), "nodes": _total("nodes"), "carried": F.array_sort(F.array_distinct(F.flatten(F.collect_set(detail("carried", "array<string>")))))},
        lambda: [F.format_string("* %d nodes in %d files", "nodes", "n"), F.when(F.size("carried") > 0, F.concat(F.lit("* Points carry "), F.array_join("carried", ", "))).otherwise("* Points carry nothing but their place")],
    ),
}


def totals(rows: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, place, line) of what the records of a kind come to, per group; lines that have nothing to say aren't there."""
    table = TABLES[kind]
    summed = rows.where(F.col("kind") == kind).groupBy(*by).agg(*[c.alias(n) for n, c in table.sums().items()]).where("n > 0")
    lines = summed.select(*by, F.posexplode(F.array(*table.lines())).alias("place", "line"))
    return lines.where("line is not null").select(*by, F.lit(kind).alias("kind"), "place", "line")


def cells(rows: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, name, line) of each record of a kind: its own cells between its name and what all kinds have."""
    ratio = F.coalesce(F.format_string("%.2fx", F.bround("ratio", 2)), F.lit("-"))
    own = [F.col("name"), *TABLES[kind].cells(), format_bytes(F.col("size")), _text(F.col("codec")), F.when(F.col("ratio").isNull(), "-").otherwise(ratio)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *own), F.lit(" |"))
    return rows.where(F.col("kind") == kind).select(*by, "kind", "name", line.alias("line"))


def report(rows: DataFrame) -> DataFrame:
    """(part, line_no, line) of all kinds that there are, each with its title, what it comes to, and its table."""
    from quarry.operators.order import numbered
    from quarry.plans.tables import written

    rows = written(rows, "layouts")
    there = {r[0] for r in rows.select("kind").distinct().collect()}
    out = None
    for part, kind in enumerate(k for k in _KINDS if k in there):
        header = ["name", *TABLES[kind].header, "size", "codec", "ratio"]
        sums = totals(rows, kind).select((F.col("place") + 2).cast("long").alias("line_no"), "line")
        top = rows.sparkSession.createDataFrame([(0, f"## {TABLES[kind].title}"), (1, ""), (20, ""), (21, "| " + " | ".join(header) + " |"), (22, "|" + " --- |" * len(header))], "line_no long, line string")
        body = numbered(cells(rows, kind), ["name", "line"], name="at").select((F.col("at") + 23).alias("line_no"), "line")
        one = top.unionByName(sums).unionByName(body).select(F.lit(part).alias("part"), "line_no", "line")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line")).limit(0)
