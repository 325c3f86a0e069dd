"""Weight tables derived from the test tables, which hold none. From maxima and whole-number
arithmetic only, so that any engine starts from the same bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.select(F.concat(F.lit("U"), F.col("user_id") % 8).alias("symbol"), F.col("ts").alias("dt"), (100 + F.col("value") / 1e1).alias("price"), "event_id")


def daily_weights(spark: SparkSession, folder: str) -> DataFrame:
    """W1: several years of daily bars of five symbols."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    g = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("dt")).agg(F.max("o_totalprice").alias("p"), F.sum("o_orderkey").alias("k"))
    return g.select("symbol", "dt", (((F.col("k") * 37) % 201 - 100) / 1e2).alias("weight"), (F.round((100 + F.col("p") / 5e3) * 1e4) / 1e4).alias("price"))


def intraday_weights(spark: SparkSession, folder: str) -> DataFrame:
    """W2: a month of bars within days, eight symbols, weights anywhere between -1 and 1."""
    return _events(spark, folder).select("symbol", "dt", (((F.col("event_id") * 37) % 201 - 100) / 1e2).alias("weight"), "price")


def stepwise_weights(spark: SparkSession, folder: str) -> DataFrame:
    """W3: as W2 with five weights, for opening, adding, closing in part, turning over."""
    return _events(spark, folder).select("symbol", "dt", ((F.col("event_id") % 5 - 2) * 25 / 1e2).alias("weight"), "price")


def klines(spark: SparkSession, folder: str) -> DataFrame:
    """KL: symbol, dt, open, close, vol."""
    e = _events(spark, folder)
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("dt"))
    return e.select("symbol", "dt", F.coalesce(before, F.col("price")).alias("open"), F.col("price").alias("close"), (1 + F.col("event_id") % 100).alias("vol"))


def strategies(spark: SparkSession, folder: str) -> DataFrame:
    """EN: symbol, dt and the weights of three strategies."""
    w = F.col("weight")
    return daily_weights(spark, folder).select("symbol", "dt", w.alias("w1"), (-w / 2).alias("w2"), F.when(w > 0.5, F.lit(None)).otherwise(w / 4).alias("w3"))
