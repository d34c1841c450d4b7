"""Views of the driver's tables in the shelf data model, in Spark and in SQL."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2001, 11, 5)
AS_OF_SQL = "TIMESTAMP '2001-11-05 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files, be it a folder of them or one file."""
    files = spark.readStream.schema(table(spark, folder, name).schema)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"{name}.parquet"))
    if place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return files.parquet(place.toString())
    # A stream takes no single file.
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def products(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("brand_id"),
        F.col("p_type").alias("flavor"),
        F.col("p_size").alias("size"),
        F.concat_ws("-", F.lit("SKU"), F.col("p_partkey").cast("string")).alias("sku"),
        F.concat(
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")),
            F.lit("_"),
            F.col("p_size").cast("string"),
            F.lit("ml_"),
            F.lower("p_type"),
        ).alias("label"),
    )


def stores(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("store_id"),
        F.col("s_name").alias("store_name"),
        F.col("n_name").alias("district"),
        (F.lit(36.25) + ((F.lit(37) * k * k + F.lit(11) * k) % 1000) * F.lit(1e-4)).alias("lat"),
        (F.lit(59.55) + ((F.lit(53) * k * k + F.lit(29) * k) % 1000) * F.lit(1e-4)).alias("lng"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_quantity").cast("int").alias("detected_count"),
        F.col("l_extendedprice").alias("shelf_area"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.col("l_shipdate").alias("observed_at"),
    )


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return products(spark, folder).select("brand_id").distinct()


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One labelled crop per lineitem row, with the sentinel labels planted by rule."""
    li = table(spark, folder, "lineitem")
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    named = F.concat(
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")),
        F.lit("_"),
        F.col("p_size").cast("string"),
        F.lit("ml_"),
        F.lower("p_type"),
    )
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("photo"),
        F.when(F.col("l_discount") <= 0.02, F.lit("low_confidence"))
        .when(F.col("p_type") == "PROMO", F.lit("non_beverage"))
        .when(F.col("p_type") == "SMALL", F.lit("unknown_beverage"))
        .otherwise(named)
        .alias("product"),
        (F.lit(1.0) - F.col("l_discount")).alias("score"),
        F.col("l_extendedprice").alias("area"),
    )


def class_label(col: str = "label") -> Column:
    """Name of a numeric embedding class."""
    c = F.col(col)
    return (
        F.when(c == 8, F.lit("unknown_beverage"))
        .when(c == 9, F.lit("non_beverage"))
        .otherwise(
            F.concat(
                F.lit("brand"), (c % 3).cast("string"), F.lit("_1L_flavour"), c.cast("string")
            )
        )
    )


def crops(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled vectors with their source photo."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        class_label().alias("label"),
        F.floor(F.col("vec_id") / 7).cast("long").alias("photo"),
        F.col("embedding").alias("vec"),
    )


# SQL text of the same views, for the DuckDB side.
PRODUCTS_SQL = """products AS (
  SELECT p_partkey AS product_id, p_brand AS brand_id, p_type AS flavor, p_size AS size,
         'SKU-' || p_partkey AS sku,
         replace(lower(p_brand), '#', '') || '_' || p_size || 'ml_' || lower(p_type) AS label
  FROM part)"""

STORES_SQL = """stores AS (
  SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS district,
         36.25::DOUBLE + ((37 * s_suppkey * s_suppkey + 11 * s_suppkey) % 1000)::DOUBLE * 1e-4::DOUBLE AS lat,
         59.55::DOUBLE + ((53 * s_suppkey * s_suppkey + 29 * s_suppkey) % 1000)::DOUBLE * 1e-4::DOUBLE AS lng
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

OBS_SQL = """obs AS (
  SELECT l_partkey AS product_id, l_suppkey AS store_id, l_quantity::INTEGER AS detected_count,
         l_extendedprice AS shelf_area, 1.0::DOUBLE - l_discount AS confidence, l_shipdate AS observed_at
  FROM lineitem)"""

PRED_SQL = """pred AS (
  SELECT l_orderkey AS photo,
         CASE WHEN l_discount <= 0.02 THEN 'low_confidence' WHEN p_type = 'PROMO' THEN 'non_beverage'
              WHEN p_type = 'SMALL' THEN 'unknown_beverage'
              ELSE replace(lower(p_brand), '#', '') || '_' || p_size || 'ml_' || lower(p_type) END AS product,
         1.0::DOUBLE - l_discount AS score, l_extendedprice AS area
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CROPS_SQL = """crops AS (
  SELECT vec_id AS id,
         CASE WHEN label = 8 THEN 'unknown_beverage' WHEN label = 9 THEN 'non_beverage'
              ELSE 'brand' || (label % 3) || '_1L_flavour' || label END AS label,
         (vec_id // 7)::BIGINT AS photo, embedding::DOUBLE[] AS vec
  FROM embeddings)"""

MARKET_SQL = ", ".join((PRODUCTS_SQL, STORES_SQL, OBS_SQL))
