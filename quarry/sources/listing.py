"""Sources of object listings, all as tables: folders, JSON lists, archive members, Parquet footers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.objects import registered

SIZES = "uri string, key string, size long"


def list_objects(spark: SparkSession, root: str, under: str = "", pattern: str | None = None) -> DataFrame:
    """(uri, key relative to root, size) of all objects under a folder, or of one object; contents aren't loaded.

    Objects whose names begin with ``_`` or ``.`` are there as well.  ``under`` names a
    folder below the root that alone is listed; ``pattern`` is a regular expression found
    anywhere in the key, and of one like ``^(A|B)...`` only the branches are opened.
    """
    source = registered(spark).read.format("objects")
    if under:
        source = source.option("prefix", under.strip("/") + "/")
    if pattern:
        source = source.option("pattern", pattern)
    found = source.load(root.rstrip("/") or "/")
    return found.where(F.regexp_like("key", F.lit(pattern))) if pattern else found


def object_size(spark: SparkSession, uri: str) -> int | None:
    """Size of one object, None where there is none.  A group of points has the size of its granule."""
    at = re.sub(r"^PIXC:(.*?)::.*$", r"\1", uri)
    if at.endswith("/"):
        return None
    got = registered(spark).read.format("objects").option("single", "true").load(at).first()
    return got["size"] if got else None


def select_objects(listing: DataFrame, prefix: str | None = None, suffix: str | None = None, pattern: str | None = None, limit: int | None = None, whole_parts: bool = True) -> DataFrame:
    """Conjunction of prefix, suffix and regular expression (found anywhere in the key), sorted by key, up to a limit.

    A prefix stands for whole path parts, as in folders: ``a/b`` has ``a/b`` and ``a/b/c``
    but not ``a/bc``.  Without ``whole_parts`` it is any beginning of the key, as object
    stores take it.
    """
    if limit is not None and limit <= 0:
        return listing.limit(0)
    out = listing
    if prefix and whole_parts:
        p = prefix.strip("/")
        # The first condition follows from the second; sources take it over.
        out = out.where(F.col("key").startswith(p)).where((F.col("key") == p) | F.col("key").startswith(f"{p}/"))
    elif prefix:
        out = out.where(F.col("key").startswith(prefix))
    if suffix:
        out = out.where(F.col("key").endswith(suffix))
    if pattern:
        out = out.where(F.regexp_like("key", F.lit(pattern)))
    return out.orderBy("key") if limit is None else out.orderBy("key").limit(limit)


def json_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of a JSON array of numbers or of {name, size}; an entry without a whole size from 0 raises and is named."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "entry"))
    named = F.get_json_object("entry", "$.name")
    size = F.coalesce(F.try_to_number("entry", F.lit("9999999999999999999")).cast("long"), F.get_json_object("entry", "$.size").try_cast("long"))
    bad = size.isNull() | (size < 0)
    return each.select(F.coalesce(named, F.concat(F.lit("#"), F.col("at"))).alias("name"), F.when(bad, F.raise_error(F.format_string("entry %s of the listing has no size: %s", "at", "entry")).cast("long")).otherwise(size).alias("size"))


def _opened(uri: str):
    """A seekable file inside a task: of the machine's file system, or of any that Arrow knows by its scheme."""
    from pyarrow import fs

    if re.match(r"^(file:|/)", uri):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _named(spark: SparkSession, root: str, pattern: str, limit: int | None = None) -> DataFrame:
    """(path, length) of files of a name pattern under a folder, the first ones by path up to a limit; contents aren't loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    return files if limit is None else files.orderBy("path").limit(limit)


def zip_members(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(uri, member, size) of the archives under a folder, the first ``limit`` by path where given; directories are left out.  Of an archive only its directory is read."""

    def run(batches):
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with _opened(uri) as f, zipfile.ZipFile(f) as z:
                    rows = [{"uri": uri, "member": i.filename, "size": i.file_size} for i in z.infolist() if not i.is_dir()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema({"uri": pa.string(), "member": pa.string(), "size": pa.int64()}))

    return _named(spark, root, "*.zip", limit).select("path").mapInArrow(run, "uri string, member string, size long")


def parquet_layout(spark: SparkSession, root: str) -> DataFrame:
    """(uri, size, rows, row_groups, max_group_rows, codec, uncompressed_bytes, geo) of Parquet files under a folder, of which only the footers are read; ``geo`` is the text that a geographic file keeps under that key, else null."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = pa.schema({"uri": pa.string(), "size": pa.int64(), "rows": pa.int64(), "row_groups": pa.int64(), "max_group_rows": pa.int64(), "codec": pa.string(), "uncompressed_bytes": pa.int64(), "geo": pa.string()})
        for batch in batches:
            rows = []
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with _opened(uri) as f:
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                codec = groups[0].column(0).compression.lower() if groups and groups[0].num_columns else None
                geo = (meta.metadata or {}).get(b"geo")
                rows.append({"uri": uri, "size": size, "rows": meta.num_rows, "row_groups": len(groups), "max_group_rows": max((g.num_rows for g in groups), default=0), "codec": codec, "uncompressed_bytes": sum(g.column(c).total_uncompressed_size for g in groups for c in range(g.num_columns)), "geo": geo.decode() if geo else None})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return _named(spark, root, "*.parquet").mapInArrow(run, "uri string, size long, rows long, row_groups long, max_group_rows long, codec string, uncompressed_bytes long, geo string")


def gradient(spark: SparkSession, side: int = 512) -> DataFrame:
    """A made-up raster of three bands: (band, row, col, value) of a gradient."""
    n = side * side
    cells = spark.range(n).select(F.expr(f"id div {side}").alias("row"), (F.col("id") % side).alias("col"))
    value = F.array(F.col("col") * 255 / (side - 1), F.col("row") * 255 / (side - 1), (F.col("row") + F.col("col")) * 255 / (2 * side - 2))
    return cells.select("row", "col", F.posexplode(value).alias("band", "value")).select((F.col("band") + 1).alias("band"), "row", "col", F.floor("value").cast("double").alias("value"))
