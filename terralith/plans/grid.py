"""Pixel relations, feature tables and samples made from the tables of a star schema, for the parity queries.

Order keys run from 0 without gaps, so they are the places of a grid of 100 columns. Bands are whole numbers, so
that sums over them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
#: The grid's transform: a row down is 1 less in y.
TRANSFORM = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_label(row: Column, col: Column) -> Column:
    return (1 + F.floor(row / 5) * 10 + F.floor(col / 10)).cast("int")


def sheared_label(row: Column, col: Column) -> Column:
    return (1 + F.floor(row / 5) * 10 + F.floor((col + row % 5) % WIDTH / 10)).cast("int")


def pixels(spark: SparkSession, sf_dir: str, sheared: bool = False, gaps: bool = True) -> DataFrame:
    """row, col, b0 (order price in thousands), b1 (customer balance in tens), b2 (units ordered), segment_id. With
    gaps, every 17th pixel is nodata."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    units = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_quantity")).cast("double").alias("b2"))
    row, col = F.floor(F.col("o_orderkey") / WIDTH).cast("int"), (F.col("o_orderkey") % WIDTH).cast("int")
    label = (sheared_label if sheared else block_label)(row, col)
    if gaps:
        label = F.when(F.col("o_orderkey") % 17 == 0, F.lit(0)).otherwise(label)
    return orders.join(customers, "o_custkey").join(units, "o_orderkey", "left").select(
        row.alias("row"), col.alias("col"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("b0"), F.floor(F.col("c_acctbal") / 10).cast("double").alias("b1"),
        F.coalesce("b2", F.lit(0.0)).alias("b2"), label.alias("segment_id"),
    )


def coarse_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir, gaps=False)
    return px.withColumn("segment_id", (1 + F.floor(F.col("row") / 8) * 3 + F.floor(F.col("col") / 37)).cast("int"))


def period(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    """segment_id (a supplier), lines, units and rebate of what was shipped before or after a day."""
    day = F.lit("1998-07-01").cast("timestamp")
    lines = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= day if after else F.col("l_shipdate") < day)
    return lines.groupBy((F.col("l_suppkey") + 1).cast("int").alias("segment_id")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum(F.floor("l_quantity")).cast("double").alias("units"), F.sum(F.round(F.col("l_discount") * 100)).alias("rebate")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, f0 and so on for every component, label from the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select((F.col("vec_id") + 1).cast("int").alias("segment_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)), "label")


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True and predicted classes of the embeddings; every fifth is wrong, sometimes by a class that doesn't exist."""
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("segment_id"), "vec_id", "label")
    true = e.select("segment_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_label"))
    wrong = (F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 11
    return true, e.select("segment_id", F.concat(F.lit("c"), wrong.cast("string")).alias("class_label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select((k * 37 % 110 + F.lit(0.5)).alias("x"), (-(k * 13 % 160) - F.lit(0.5)).alias("y"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("class"), k.alias("sample_ord"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    x, y = (k * 11 % 110).cast("double"), (k * 7 % 160).cast("double")
    return s.select((x - 2).alias("min_x"), (-y - k % 5 - 0.5).alias("min_y"), (x + k % 4 + 0.25).alias("max_x"), (-y).alias("max_y"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("class"), k.alias("sample_ord"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's results, made from the nations."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select("n_name", (k * 3).cast("bigint").alias("n_segments"), (k * F.lit(0.25)).alias("duration_s"), F.when(k % 7 == 0, F.lit("failed")).alias("error")).withColumnRenamed("n_name", "input_path")
