"""Column expressions over object addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_bucket_uri(uri: Column) -> Column:
    return uri.startswith("s3://")


def bucket(uri: Column) -> Column:
    """Bucket of an ``s3://`` address, else null; such an address without a bucket is an error."""
    named = F.nullif(F.regexp_extract(uri, r"^s3://([^/]+)", 1), F.lit(""))
    return F.when(is_bucket_uri(uri) & named.isNull(), F.raise_error(F.concat(F.lit("no bucket in "), uri)).cast("string")).otherwise(named)


def key(uri: Column) -> Column:
    """Key below the bucket, else null; an address without a bucket is an error."""
    return F.when(bucket(uri).isNotNull(), F.regexp_extract(uri, r"^s3://[^/]+/?(.*)$", 1))


def reader_path(uri: Column) -> Column:
    """Address as a virtual file-system path: ``/vsis3/`` before bucket and key; others stay."""
    return F.when(is_bucket_uri(uri), F.regexp_replace(uri, "^s3://", "/vsis3/")).otherwise(uri)


def zip_container(path: Column) -> Column:
    """Archive that a ``/vsizip/`` path lies in, else null."""
    return F.nullif(F.regexp_extract(path, r"^/vsizip/(?:\{)?(.*?\.zip)", 1), F.lit(""))


def netcdf_container(path: Column) -> Column:
    """File of a ``NETCDF:"file":variable`` address, else null."""
    return F.nullif(F.regexp_extract(path, r'^NETCDF:"([^"]+)":', 1), F.lit(""))


def member_uri(archive: Column, member: Column) -> Column:
    return F.concat(F.lit("/vsizip/"), archive, F.lit("/"), member)


def base_name(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def stem_without(uri: Column, suffix: str) -> Column:
    """Base name without a suffix, if it has it."""
    name = base_name(uri)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def extension(uri: Column) -> Column:
    """Lower-case extension of the base name; the query is left out."""
    return F.lower(F.regexp_extract(base_name(F.substring_index(uri, "?", 1)), r"(\.[^.]*)$", 1))


def date_of(stem: Column) -> Column:
    """First run of eight digits as a date, else null."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(stem, r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def epsg_of(wkt: Column) -> Column:
    """Last EPSG code in a projection's text, else null."""
    return F.try_element_at(F.regexp_extract_all(wkt, F.lit(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]'), F.lit(1)), F.lit(-1)).cast("int")


def join_uri(base: Column, name: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), name)


def format_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KiB`` and on up to PiB: steps of 1024, one decimal above bytes, halves to the even neighbour."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out


#: Scheme of addresses of groups of points in a granule, and the group that stands where none is named.
CLOUD, MAIN_GROUP = "PIXC:", "pixel_cloud"


def cloud_address(granule: Column, group: Column, include: Column, exclude: Column) -> Column:
    """``PIXC:<granule>::<group>?include=a,b&exclude=c``: the columns to carry (null: all, an empty list: none), and those to leave out, if any."""
    asked = F.concat_ws("&", F.when(include.isNotNull(), F.concat(F.lit("include="), F.array_join(include, ","))), F.when(F.size(exclude) > 0, F.concat(F.lit("exclude="), F.array_join(exclude, ","))))
    return F.concat(F.lit(CLOUD), granule, F.lit("::"), group, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def parse_cloud_address(address: Column) -> Column:
    """(granule, group, include, exclude) of such an address: include is null where it isn't given."""
    rest = F.substring(address, F.lit(len(CLOUD) + 1), F.length(address))
    base, query = F.substring_index(rest, "?", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    given = lambda k: F.filter(F.split(F.regexp_extract(query, f"(?:^|&){k}=([^&]*)", 1), ","), lambda x: x != "")
    group = F.substring_index(base, "::", -1)
    granule = F.substring(base, F.lit(1), F.length(base) - F.length(group) - 2)
    return F.struct(granule.alias("granule"), F.when(group == "", MAIN_GROUP).otherwise(group).alias("group"), F.when(F.regexp_like(query, F.lit("(^|&)include=")), given("include")).alias("include"), given("exclude").alias("exclude"))
