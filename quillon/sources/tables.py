"""Candle series derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import SERIES, series_window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(bars: DataFrame, order: str = "ts") -> DataFrame:
    """Adds pos: the 0-based position of a bar in its series, by time or another order."""
    from pyspark.sql.window import Window

    return bars.withColumn("pos", F.row_number().over(Window.partitionBy(*SERIES).orderBy(order)) - 1)


def _candles(rows: DataFrame, interval: str) -> DataFrame:
    """rows: symbol, ts (bucket), price, at (total order inside a bucket)."""
    bars = rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return numbered(bars.withColumn("interval", F.lit(interval))).select("symbol", "interval", "pos", "ts", "open", "high", "low", "close", "volume")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of event values, one series for each event type."""
    e = table(spark, sf_dir, "events")
    return _candles(e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("at")), "1h")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of order totals, one series for each priority."""
    o = table(spark, sf_dir, "orders")
    return _candles(o.select(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("at")), "1d")


def every_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly and daily candles of the same events, and daily and monthly ones of the same orders, as one table of series."""
    from ..operators.resample import resample

    hourly, daily = bars_1h(spark, sf_dir), bars_1d(spark, sf_dir)
    again = lambda bars, rule, interval: resample(bars, rule).withColumn("interval", F.lit(interval)).select(*hourly.columns)
    return hourly.unionByName(again(hourly, "1D", "1d")).unionByName(daily).unionByName(again(daily, "1ME", "1mo"))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles with defects at fixed positions, so that every check has something to find."""
    b = bars_1h(spark, sf_dir)
    at = lambda k, r: F.col("pos") % k == r
    w = series_window()
    return b.select(
        "symbol",
        "interval",
        "pos",
        F.when(at(97, 11), F.lag("ts", 1).over(w)).when(at(101, 13), F.lag("ts", 2).over(w)).otherwise(F.col("ts")).alias("ts"),
        F.when(at(53, 7), F.lit(None).cast("double")).otherwise(F.col("open")).alias("open"),
        F.when(at(61, 9), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(at(67, 10), F.col("close") + 1).when(at(71, 3), -F.col("low")).otherwise(F.col("low")).alias("low"),
        F.when(at(59, 8), F.lit(None).cast("double")).otherwise(F.col("close")).alias("close"),
        F.when(at(73, 5), F.lit(None).cast("double")).when(at(79, 6), -F.col("volume")).when((F.col("pos") >= 20) & (F.col("pos") < 32), F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )
