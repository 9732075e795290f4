"""Cubes over the synthetic tables: months of line items on a globe of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.measures import cell_area


def grid(spark: SparkSession, sf_dir: str, status: str, n_lat: int = 9, n_lon: int = 18, layered: bool = False) -> DataFrame:
    """Monthly mean quantities on an ``n_lat`` by ``n_lon`` grid; the line
    number is the layer of a layered cube."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linestatus") == status)
    keys = [
        (F.col("l_suppkey") % n_lat).cast("int").alias("lat_idx"), (F.col("l_partkey") % n_lon).cast("int").alias("lon_idx"),
        *([F.col("l_linenumber").alias("depth_idx")] if layered else []), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
    ]
    return items.groupBy(*keys).agg(F.avg("l_quantity").alias("value"))


def area(n_lat: int = 9, n_lon: int = 18) -> Column:
    """Cell areas in 1e12 m2."""
    lo = F.col("lat_idx") * (180.0 / n_lat) - 90
    return cell_area(lo, lo + 180.0 / n_lat, F.lit(0.0), F.lit(360.0 / n_lon)) / 1e12


def cells(df: DataFrame, n_lat: int = 9, n_lon: int = 18) -> DataFrame:
    """With cell centres ``lat`` and ``lon``."""
    return df.withColumn("lat", (F.col("lat_idx") + 0.5) * (180.0 / n_lat) - 90).withColumn("lon", (F.col("lon_idx") + 0.5) * (360.0 / n_lon) - 180)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites: monthly mean order prices."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = orders.groupBy(F.col("c_nationkey").alias("site_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("value"))
    return out.withColumn("lat", -84.0 + 7 * F.col("site_id")).withColumn("lon", -168.0 + 14 * F.col("site_id"))


def series(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linestatus") == status)
    return items.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg((F.sum("l_extendedprice") / 1e6).alias("value"))
