"""Spectra-shaped views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 1100.0

#: The same views for DuckDB, as the head of a WITH clause.
SQL = """peaks AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS peak_id,
         concat('s', l_suppkey % 4) AS sample, l_suppkey AS scan_id, l_extendedprice / 100 AS mz, l_quantity AS i,
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS polarity, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS ms_level,
         l_linenumber AS n_scans, l_discount * 100 AS time, l_returnflag AS flag
  FROM lineitem),
scans AS (
  SELECT o_orderkey AS scan_id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS polarity,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS ms_level, o_totalprice / 500 AS target_mz, o_custkey % 4 AS run,
         o_orderkey % 100 AS time, o_totalprice AS tic
  FROM orders),
targets AS (SELECT p_partkey AS target_id, p_retailprice AS target_mz, p_type AS class FROM part)"""


def peaks(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("peak_id"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample"),
        F.col("l_suppkey").alias("scan_id"),
        (F.col("l_extendedprice") / 100).alias("mz"),
        F.col("l_quantity").alias("i"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("ms_level"),
        F.col("l_linenumber").alias("n_scans"),
        (F.col("l_discount") * 100).alias("time"),
        F.col("l_returnflag").alias("flag"),
    )


def scans(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    return t.select(
        F.col("o_orderkey").alias("scan_id"),
        F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("polarity"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("ms_level"),
        (F.col("o_totalprice") / 500).alias("target_mz"),
        (F.col("o_custkey") % 4).alias("run"),
        (F.col("o_orderkey") % 100).alias("time"),
        F.col("o_totalprice").alias("tic"),
    )


def targets(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select(F.col("p_partkey").alias("target_id"), F.col("p_retailprice").alias("target_mz"), F.col("p_type").alias("class"))


def sample_maps(spark: SparkSession, d: str) -> DataFrame:
    """part, m: summed intensity per sample, as a map, of each part."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("part"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample")).agg(F.sum("l_quantity").alias("i"))
    return t.groupBy("part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "i")))).alias("m"))


MAPS_SQL = """long AS (SELECT l_partkey AS part, concat('s', l_suppkey % 4) AS sample, sum(l_quantity) AS i FROM lineitem GROUP BY ALL)"""
