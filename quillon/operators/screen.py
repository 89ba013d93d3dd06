"""Universe screening: liquidity and volatility of every series, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SERIES, ratio, series_window

CRORE, TRADING_DAYS, MIN_CLOSES = 1e7, 252, 60
SUSPECT_VOL_RATIO, SUSPECT_JUMP = 14, 0.35


def measure(bars: DataFrame) -> DataFrame:
    """One row for each series with enough closes. bars: with atr, missing closes left out before it was made.

    The largest jump is the first of equals. A suspect series looks as if a corporate action had not
    been adjusted for; it is reported, not dropped.
    """
    w = series_window()
    jump = F.col("close") / F.lag("close").over(w) - 1
    rows = bars.filter(F.col("close").isNotNull()).select(*SERIES, "pos", "ts", "close", "volume", "atr", jump.alias("jump"))
    out = rows.groupBy(*SERIES).agg(
        F.count("close").alias("bars"),
        (F.median(F.col("close") * F.col("volume")) / CRORE).alias("turnover"),
        (F.median(ratio(F.col("atr"), F.col("close"))) * 100).alias("atr_pct"),
        (F.stddev_samp("jump") * (TRADING_DAYS**0.5) * 100).alias("stdev_vol"),
        (F.max(F.abs("jump")) * 100).alias("max_jump"),
        F.min_by("ts", F.when(F.col("jump").isNotNull(), F.struct(-F.abs("jump"), F.col("pos")))).alias("jump_ts"),
    ).filter(F.col("bars") >= MIN_CLOSES)
    out = out.withColumn("vol_ratio", F.when(F.col("atr_pct") > 0, F.col("stdev_vol") / F.col("atr_pct")).otherwise(0.0)).withColumn("max_jump_date", F.date_format("jump_ts", "yyyy-MM-dd"))
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("vol_ratio") > SUSPECT_VOL_RATIO, F.concat(F.lit("vol ratio "), F.bround("vol_ratio", 0).cast("long").cast("string"))),
        F.when(F.col("max_jump") > SUSPECT_JUMP * 100, F.concat(F.bround("max_jump", 0).cast("long").cast("string"), F.lit("% jump on "), F.col("max_jump_date"))),
    )
    out = out.select(*SERIES, "bars", F.round("turnover", 1).alias("median_turnover_cr"), F.round("atr_pct", 2).alias("median_atr_pct"), F.round("stdev_vol", 1).alias("stdev_vol_annual"), F.round("vol_ratio", 1).alias("vol_ratio"), F.round("max_jump", 1).alias("max_jump_pct"), "max_jump_date", reasons.alias("suspect"))
    active = (F.col("median_turnover_cr") > 0) & (F.col("median_atr_pct") > 0)
    return out.withColumn("score", F.when(active, F.round(F.log10("median_turnover_cr") * F.col("median_atr_pct"), 3)).otherwise(0.0))


def buckets(screened: DataFrame, min_turnover: float) -> DataFrame:
    """Adds bucket: clean, flagged (suspect) or thin (below the turnover floor)."""
    return screened.withColumn("bucket", F.when(F.col("suspect") != "", "flagged").when(F.col("median_turnover_cr") >= min_turnover, "clean").otherwise("thin"))


def with_sectors(screened: DataFrame, sectors: DataFrame) -> DataFrame:
    """sectors: symbol, sector; a small dimension, whose size the optimizer judges for itself."""
    return screened.join(sectors, "symbol", "left")
