"""Domain views over the provided tables: observations, cells, sites, targets, an ensemble and a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_since(ts, origin: str):
    """Seconds from a timestamp literal (without time zone) to ts."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{origin}', {ts})") / F.lit(1e6)


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, elm, typ, dif (s), dat, err, dep: events as observations; the background is the mean of the element."""
    e = table(spark, sf_dir, "events")
    mean = e.groupBy("event_type").agg(F.avg("value").alias("bg"))  # one row per element
    return e.join(mean, "event_type").select(
        F.col("event_id").alias("obs_id"), F.col("event_type").alias("elm"), (F.col("user_id") % 4).alias("typ"), seconds_since("ts", "2024-01-16").alias("dif"),
        F.col("value").alias("dat"), (0.25 * F.col("bg")).alias("err"), (F.col("value") - F.col("bg")).alias("dep"),
    )


def v_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, k, z, vr, err, tax, ts, okey: line items as samples in 20 x 20 x 7 cells."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 20).cast("int").alias("i"), (F.col("l_suppkey") % 20).cast("int").alias("j"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("z"),
        F.col("l_quantity").alias("vr"), F.col("l_discount").alias("err"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("okey"),
    )


def v_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, x, y, lev, dat, ctype: parts as point observations; positions tie on purpose."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("obs_id"), (F.col("p_partkey") * 7919 % 1000 / 10).alias("x"), (F.col("p_partkey") * 104729 % 1000 / 10).alias("y"),
        F.col("p_size").alias("lev"), F.col("p_retailprice").alias("dat"), F.col("p_brand").alias("ctype"),
    )


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, x, y, lev: suppliers as target points."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") * 6151 % 1000 / 10).alias("x"), (F.col("s_suppkey") * 3079 % 1000 / 10).alias("y"), F.lit(25.0).alias("lev")
    )


def v_ens_array(spark: SparkSession, sf_dir: str, members: int = 10) -> DataFrame:
    """vec_id, elm, ens: the first numbers of each embedding as an ensemble."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("elm"), F.slice("embedding", 1, members).cast("array<double>").alias("ens"))


def v_ens(spark: SparkSession, sf_dir: str, members: int = 10) -> DataFrame:
    """vec_id, elm, member (from 1), x."""
    return v_ens_array(spark, sf_dir, members).select("vec_id", "elm", F.posexplode("ens").alias("m", "x")).select("vec_id", "elm", (F.col("m") + 1).alias("member"), "x")


def v_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, total, n: orders by day."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return o.agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


def r(col, digits: int = 4, fine: int | None = None):
    """Rounded for comparison between engines.

    Means of decimals fall on ties, which engines break differently. With fine, the value is first rounded to that many
    digits, as the SQL does by a decimal of that scale, so that a tie is one in both.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(col, fine) if fine else col, digits)
