"""Catalogues of products and components: selections by reader, order, bundles, composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import free_names
from quarry.functions.uri import base_name, cloud_address, stem_without
from quarry.sources.registry import readers


@readers.register("archive-bands")
def archive_bands(members: DataFrame, bands: Sequence[str], masks: Sequence[str] = (), fine: Sequence[str] = ("B2", "B3", "B4", "B8")) -> DataFrame:
    """Reflectance bands and masks of scene archives (uri, member): bands ``*_FRE_<band>.tif``, masks ``MASKS/*_<KIND>_<Rn>.tif``.

    Ordered by masks last, 10 m bands first, then name; bands carry scale 1e-4 and no-data -10000.
    """
    name = base_name(F.col("member"))
    band = F.upper(F.regexp_extract(name, r"(?i)_FRE_(B\w+)\.tif$", 1))
    mask = F.upper(F.regexp_extract(name, r"(?i)_([A-Z]+_R\d)\.tif$", 1))
    is_mask = F.col("member").contains("/MASKS/")
    out = members.withColumns({"component": F.when(is_mask, mask).otherwise(band), "is_mask": is_mask})
    keep = F.when(F.col("is_mask"), F.regexp_extract("component", r"^([A-Z]+)_", 1).isin([m.upper() for m in masks])).otherwise(F.col("component").isin([b.upper() for b in bands]))
    out = out.where((F.col("component") != "") & keep)
    out = out.withColumns({"nodata": F.when(~F.col("is_mask"), F.lit(-10000.0)), "scale": F.when(~F.col("is_mask"), F.lit(1e-4)), "product": stem_without(F.col("uri"), ".zip")})
    return out.orderBy("product", "is_mask", ~F.col("component").isin([b.upper() for b in fine]), "component")


@readers.register("radar-polarisations")
def radar_polarisations(members: DataFrame, polarisations: Sequence[str] = ("VV", "VH")) -> DataFrame:
    """Rasters ``*_<VV or VH>_GAM_*.tif`` of scene archives, in the order in which the polarisations are asked for."""
    pol = F.upper(F.regexp_extract(base_name(F.col("member")), r"(?i)_(VV|VH)_GAM_.*\.tif$", 1))
    order = F.array_position(F.array(*[F.lit(p) for p in polarisations]), F.col("component"))
    out = members.withColumns({"component": pol, "product": stem_without(F.col("uri"), ".zip")}).withColumn("place", order)
    return out.where(F.col("place") > 0).orderBy("product", "place")


@readers.register("shape-archives")
def shape_archives(members: DataFrame) -> DataFrame:
    """Members ``.shp`` (and not ``.shp.xml``) by stem."""
    return members.where(F.regexp_like("member", F.lit(r"(?i)\.shp$"))).withColumns({"component": F.regexp_replace(base_name(F.col("member")), r"(?i)\.shp$", ""), "product": stem_without(F.col("uri"), ".zip")}).orderBy("product", "component")


@readers.register("granule-variables")
def granule_variables(listing: DataFrame, variables: Sequence[str], suffix: str = ".nc", found: str = "found") -> DataFrame:
    """One component for each granule and variable, addressed ``NETCDF:"file":variable``, in the order asked for; none asked for is ``wse``.

    ``all`` or ``*`` stands for every variable that the granule has, in its own order: the
    listing says them in an array column ``found``.
    """
    if {"all", "*"} & set(variables):
        if found not in listing.columns:
            raise ValueError(f"all variables are asked for, and no column {found} says which there are")
        wanted = F.col(found)
    else:
        wanted = F.array(*[F.lit(v) for v in variables or ("wse",)])
    out = listing.where(F.col("uri").endswith(suffix)).select("uri", stem_without(F.col("uri"), suffix).alias("product"), F.posexplode(wanted).alias("place", "component"))
    return out.withColumn("address", F.concat(F.lit('NETCDF:"'), "uri", F.lit('":'), "component")).orderBy("product", "place")


@readers.register("dated-granules")
def dated_granules(listing: DataFrame, suffix: str = ".tif") -> DataFrame:
    """One component a file: the first run of eight digits of its stem, else the stem."""
    stem = stem_without(F.col("uri"), suffix)
    return listing.where(F.col("uri").endswith(suffix)).select("uri", stem.alias("product"), F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d{8})", 1), F.lit("")), stem).alias("component"))


@readers.register("cloud-groups")
def cloud_groups(listing: DataFrame, groups: Sequence[str] = ("pixel_cloud",), include: Sequence[str] | None = None, exclude: Sequence[str] = (), suffix: str = ".nc") -> DataFrame:
    """One component for each granule and group of points, with an address that says which columns travel."""
    named = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    out = listing.where(F.col("uri").endswith(suffix)).select("uri", stem_without(F.col("uri"), suffix).alias("product"), F.posexplode(named(groups)).alias("place", "component"))
    carried = F.lit(None).cast("array<string>") if include is None else named(include)
    return out.withColumn("address", cloud_address(F.col("uri"), F.col("component"), carried, named(exclude))).orderBy("product", "place")


@readers.register("single-object")
def single_object(listing: DataFrame, uri: str, name: str | None = None) -> DataFrame:
    """One product of one component: an object that is named outright, whatever the listing and its bounds have."""
    stem = uri.rstrip("/").rpartition("/")[2]
    own = name or stem.partition(".")[0] or stem
    return listing.sparkSession.range(1).select(F.lit(uri).alias("uri"), F.lit(own).alias("product"), F.lit(own).alias("component"))


def viewer_bands(variables: Sequence[str], schema: Sequence[str] = ()) -> list[str]:
    """Variables that a viewer shows: those asked for, or, where ``all`` is, every one of a granule's schema."""
    return list(schema) if "all" in variables else list(variables)


def realisable(components: DataFrame, composites: dict[str, Sequence[str]]) -> DataFrame:
    """(product, composite) where a product has all of a composite's bands.  Composites are few and named, so a product's bands are looked at once."""
    have = components.where(F.col("component").isin(sorted({b for x in composites.values() for b in x}))).groupBy("product").agg(F.collect_set("component").alias("have"))
    wanted = F.filter(F.array(*[F.struct(F.lit(n).alias("composite"), F.array(*[F.lit(b) for b in bands]).alias("bands")) for n, bands in composites.items()]), lambda c: F.size(F.array_except(c["bands"], F.col("have"))) == 0)
    return have.select("product", F.explode(F.transform(wanted, lambda c: c["composite"])).alias("composite"))


def bundles(components: DataFrame, groups: dict[str, Sequence[str]] | bool | None) -> DataFrame:
    """Components with the bundle they are written in (null: alone): none, all of a product together, or named groups; a group of one stays alone, a name in two groups is in both, an unknown name is an error."""
    if not groups:
        return components.withColumn("bundle", F.lit(None).cast("string"))
    if groups is True:
        (several,) = free_names(components, "several")
        # Products of one component are found by a count, so no task sorts all components of a product.
        more = components.groupBy(F.col("product").alias(several)).agg(F.count("*").alias(f"{several}_n")).where(F.col(f"{several}_n") > 1)
        return components.join(more, F.col("product").eqNullSafe(F.col(several)), "left").select(*components.columns, F.when(F.col(f"{several}_n").isNotNull(), F.lit("all")).alias("bundle"))
    named = {n for g in groups.values() for n in g}
    known = {r[0] for r in components.where(F.col("component").isin(sorted(named))).select("component").distinct().collect()}
    if missing := named - known:
        raise ValueError(f"no such components: {sorted(missing)}")
    pairs = [(n, g) for g, names in groups.items() if len(names) > 1 for n in names]
    of = F.filter(F.array(*[F.when(F.col("component") == n, F.lit(g)) for n, g in pairs]), lambda x: x.isNotNull()) if pairs else F.array().cast("array<string>")
    return components.withColumn("bundle", F.explode_outer(of))


def merged(run: dict, own: str, table: str) -> Column:
    """A parameter: the run's where it has one, else the component's column."""
    return F.lit(run[own]) if run.get(own) is not None else F.col(table)
