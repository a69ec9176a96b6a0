"""The driver's tables seen as objects, features, cells, points and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
FILL = -10000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("product"), F.col("lang").alias("component"), F.concat_ws("/", "source", "lang", "doc_id").alias("key"), F.col("n_chars").alias("size"))


def features(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    x, y = (F.col("c_custkey") % 50).cast("double"), F.expr("c_custkey div 50").cast("double")
    there = F.col("c_custkey") % 4 != 0
    box = {"xmin": x, "ymin": y, "xmax": x + 0.5, "ymax": y + 0.5}
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), *[F.when(there, v).alias(k) for k, v in box.items()], (x + 0.25).alias("lon"), (y + 0.25).alias("lat"))


def cells(spark, d, band: str | None = None) -> DataFrame:
    key = [(F.col("l_orderkey") % SIDE).alias("row"), (F.col("l_partkey") % SIDE).alias("col")]
    grouped = table(spark, d, "lineitem").groupBy(*key, *([F.col(band).alias("band")] if band else [])).agg(F.avg("l_quantity").alias("value"))
    return grouped.withColumn("value", F.when((F.col("row") + F.col("col")) % 7 == 0, FILL).otherwise(F.col("value")))


def points(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")], "label")


def measurements(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("metric"),
        (F.col("user_id") % 5).alias("product"),
        F.when(F.col("user_id") % 3 == 0, "cold").otherwise("warm").alias("cache"),
        (F.col("user_id") % 3 + 1).alias("concurrency"),
        (F.col("event_id") % 4).alias("replicate"),
        (F.col("event_id") % 2).alias("worker"),
        "value",
    )


def writes(spark, d) -> DataFrame:
    """Writes of an order's lines, summed in decimals before they meet their order: (product, container, elapsed, bytes_out, bytes_in, components)."""
    exact = lambda c: F.sum(c.cast("decimal(28,9)"))
    price = F.col("l_extendedprice")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(exact(F.col("l_quantity")).alias("elapsed"), exact(price).alias("bytes_out"), exact(F.when(F.col("l_linenumber") % 2 == 0, price * 2)).alias("bytes_in"), F.count("*").alias("components"))
    return lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("container"), F.col("o_orderstatus").alias("product")), F.col("l_orderkey") == F.col("o_orderkey"))


#: The same views as DuckDB's common table expressions.
SQL = {
    "objects": "select source as product, lang as component, concat_ws('/', source, lang, doc_id) as key, n_chars as size from documents",
    "features": "select c_custkey as id, c_nationkey as nation, case when c_custkey % 4 <> 0 then (c_custkey % 50)::double end as xmin, case when c_custkey % 4 <> 0 then (c_custkey // 50)::double end as ymin, case when c_custkey % 4 <> 0 then (c_custkey % 50) + 0.5::double end as xmax, case when c_custkey % 4 <> 0 then (c_custkey // 50) + 0.5::double end as ymax, (c_custkey % 50) + 0.25::double as lon, (c_custkey // 50) + 0.25::double as lat from customer",
    "cells": f'select "row", col, case when ("row" + col) % 7 = 0 then {FILL} else value end as value from (select l_orderkey % {SIDE} as "row", l_partkey % {SIDE} as col, avg(l_quantity) as value from lineitem group by 1, 2)',
    "band_cells": f'select "row", col, band, case when ("row" + col) % 7 = 0 then {FILL} else value end as value from (select l_orderkey % {SIDE} as "row", l_partkey % {SIDE} as col, l_returnflag as band, avg(l_quantity) as value from lineitem group by 1, 2, 3)',
    "points": "select vec_id as pid, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings",
    "measurements": "select event_type as metric, user_id % 5 as product, case when user_id % 3 = 0 then 'cold' else 'warm' end as cache, user_id % 3 + 1 as concurrency, event_id % 4 as replicate, event_id % 2 as worker, value from events",
    "writes": "select l_quantity as elapsed, l_extendedprice as bytes_out, case when l_linenumber % 2 = 0 then l_extendedprice * 2 end as bytes_in, o_custkey as container, o_orderstatus as product, o_orderkey from lineitem join orders on l_orderkey = o_orderkey",
}


def with_views(sql: str, *names: str) -> str:
    """SQL after common table expressions of the views that it names."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + sql
