"""Typed options of readers and layouts; a name that an options class doesn't have is an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import catalog  # noqa: F401  the readers register there
from quarry.sources.registry import layouts, readers


class Kind(Enum):
    """What an object is."""

    RASTER = "raster_file"
    STORE = "zarr_store"
    VECTOR = "vector_file"
    POINTS = "point_cloud_file"


@dataclass(frozen=True)
class ArchiveBands:
    bands: Sequence[str] = ("B2", "B3", "B4", "B8")
    masks: Sequence[str] = ()


@dataclass(frozen=True)
class Polarisations:
    polarisations: Sequence[str] = ("VV", "VH")


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Variables:
    variables: Sequence[str] = ("wse",)
    suffix: str = ".nc"


@dataclass(frozen=True)
class Suffix:
    suffix: str = ".tif"


@dataclass(frozen=True)
class CloudGroups:
    groups: Sequence[str] = ("pixel_cloud",)
    include: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    suffix: str = ".nc"


@dataclass(frozen=True)
class Single:
    uri: str
    name: str | None = None


#: Options of each registered reader.
OPTIONS = {"single-object": Single, "cloud-groups": CloudGroups, "archive-bands": ArchiveBands, "radar-polarisations": Polarisations, "shape-archives": Nothing, "granule-variables": Variables, "dated-granules": Suffix}


@dataclass(frozen=True)
class Columnar:
    """Levers of Parquet files in curve order."""

    partitions: int = 8
    row_group_rows: int = 65_536
    compression: str = "zstd"


def sides(setting, default: tuple[int, int]) -> tuple[int, int] | str:
    """(rows, cols) that a setting of a chunk or shard stands for; ``auto`` stays."""
    match setting:
        case None | [] | ():
            return default
        case str() if setting.strip().lower() == "auto":
            return "auto"
        case int() | float():  # a square
            return int(setting), int(setting)
        case [[*_] as first, *_]:  # shapes to be tried: the first counts
            return sides(list(first), default)
        case [one]:
            return int(one), int(one)
        case [*_, rows, cols]:  # further axes go before these two
            return int(rows), int(cols)
    raise ValueError(f"no shape: {setting!r}")


@dataclass(frozen=True)
class Store:
    """Levers of a chunked store: shapes, and levels as ``ladders.bundle_steps`` takes them."""

    chunk: object = (512, 512)
    shard: object = "auto"
    levels: object = "auto"

    @property
    def chunk_sides(self) -> tuple[int, int] | str:
        return sides(self.chunk, (512, 512))

    @property
    def shard_sides(self) -> tuple[int, int] | str:
        return sides(self.shard, (4096, 4096))

    @property
    def flat(self) -> bool:
        """No pyramid is asked for by the number 0, and by nothing else."""
        return isinstance(self.levels, (int, float)) and not isinstance(self.levels, bool) and self.levels == 0


@dataclass(frozen=True)
class Tree:
    """Levers of an octree: cells of a node along each axis, and its greatest depth."""

    span: int = 128
    most_depth: int = 21


@dataclass(frozen=True)
class Indexed:
    """Levers of an indexed file: features of a node, and what is done with features without geometry."""

    node_size: int = 16
    null_geometry: str = "error"
    lon: str | None = None
    lat: str | None = None


def options_of(kind: type, given: Mapping | None):
    """The options object of a mapping, with defaults for what isn't given."""
    known = [f.name for f in fields(kind)]
    if unknown := sorted(set(given or {}) - set(known)):
        raise ValueError(f"unknown options {unknown}; {kind.__name__} has {known}")
    return kind(**(given or {}))


class Reader(Protocol):
    """What a reader is: a function of a listing and its options that gives components, each with its ``product``, ``component`` and where it lies (``uri``)."""

    def __call__(self, listing: DataFrame, **options) -> DataFrame: ...


#: Columns that every reader gives.
COMPONENT = ("uri", "product", "component")


def read(reader: str, listing: DataFrame, given: Mapping | None = None) -> DataFrame:
    """Components of a listing by a registered reader with checked options."""
    f = readers.get(reader)
    made = options_of(OPTIONS.get(reader, Nothing), given)
    out = f(listing, **{x.name: getattr(made, x.name) for x in fields(made)})
    if missing := set(COMPONENT) - set(out.columns):
        raise TypeError(f"reader {reader} gives no {', '.join(sorted(missing))}")
    return out


class Layout(Protocol):
    """What a layout gives: its kind, its options, a writer, a description of what lies below a folder, and its layout records."""

    kind: Kind
    options: type

    def write(self, df: DataFrame, path: str, options) -> None: ...

    def describe(self, spark, path: str) -> DataFrame: ...

    def records(self, spark, path: str) -> DataFrame: ...


class ColumnarLayout:
    """Features as Parquet along the Hilbert curve."""

    kind, options = Kind.VECTOR, Columnar

    def write(self, df: DataFrame, path: str, options: Columnar) -> None:
        from quarry.operators.spatial import write_clustered

        write_clustered(df, path, options.partitions, options.row_group_rows, options.compression)

    def describe(self, spark, path: str) -> DataFrame:
        from quarry.sources.listing import parquet_layout

        return parquet_layout(spark, path)

    def records(self, spark, path: str) -> DataFrame:
        """A record for each file."""
        from quarry.operators.layouts import records

        boxes = {"xmin", "ymin", "xmax", "ymax"} <= set(spark.read.parquet(path).columns)
        ratio = F.when(F.col("size") > 0, F.col("uncompressed_bytes") / F.col("size"))
        files = self.describe(spark, path).select(F.element_at(F.split("uri", "/"), -1).alias("name"), "size", "codec", ratio.alias("ratio"), F.col("rows").alias("features"), "row_groups", F.col("max_group_rows").alias("group_rows"), F.lit(boxes).alias("covering"))
        return records(files, "columnar")


layouts.register("columnar", ColumnarLayout())
