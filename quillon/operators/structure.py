"""Swings and market structure as windows: one partitioning by series serves them all.

A swing at bar c is confirmed at bar c + k; everything is computed at the confirming row from that
row and earlier ones, so no value ever changes when later bars arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import SERIES, before, series_window, so_far
from ..params import EngineParams


def swing_columns(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds swing_high / swing_low (price, where one is confirmed at this bar), their labels, swing_atr and swing_ts.

    A high is strictly above its k bars to the left and not below its k bars to the right; a low
    mirrors it. Bars with a missing price in the frame confirm nothing.
    """
    k, w = params.swing_lookback, series_window()
    left, right, whole = w.rowsBetween(-2 * k, -k - 1), w.rowsBetween(-k + 1, 0), w.rowsBetween(-2 * k, 0)
    high, low = F.lag("high", k).over(w), F.lag("low", k).over(w)
    ready = lambda c: F.count(c).over(whole) == 2 * k + 1
    out = bars.select(
        "*",
        F.when(ready("high") & (high > F.max("high").over(left)) & (high >= F.max("high").over(right)), high).alias("swing_high"),
        F.when(ready("low") & (low < F.min("low").over(left)) & (low <= F.min("low").over(right)), low).alias("swing_low"),
        F.lag("atr", k).over(w).alias("swing_atr"),
        F.lag("ts", k).over(w).alias("swing_ts"),
    )
    tolerance = F.coalesce(F.col("swing_atr"), F.lit(0.0)) * params.equal_level_atr

    def label(price: str, equal: str, up: str, down: str):
        now, previous = F.col(price), F.last(price, ignorenulls=True).over(before())
        return F.when(now.isNull(), None).when(previous.isNull(), "FIRST").when(F.abs(now - previous) <= tolerance, equal).when(now > previous, up).otherwise(down)

    return out.select("*", label("swing_high", "EQH", "HH", "LH").alias("high_label"), label("swing_low", "EQL", "HL", "LL").alias("low_label"))


def swings(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """One row for each swing: symbol, interval, index, confirmed_index, kind, price, label, ts. bars: with atr."""
    k = params.swing_lookback
    # explode_outer: for explode the optimizer would test the array's size in a filter of its own, and compute it twice.
    kind = lambda name, price, label: F.struct(F.lit(name).alias("kind"), F.col(price).alias("price"), F.col(label).alias("label"))
    both = F.array_compact(F.array(F.when(F.col("swing_high").isNotNull(), kind("HIGH", "swing_high", "high_label")), F.when(F.col("swing_low").isNotNull(), kind("LOW", "swing_low", "low_label"))))
    return swing_columns(bars, params).select(*SERIES, (F.col("pos") - k).alias("index"), F.col("pos").alias("confirmed_index"), F.col("swing_ts").alias("ts"), F.explode_outer(both).alias("s")).filter(F.col("s").isNotNull()).select(*SERIES, "index", "confirmed_index", "ts", "s.kind", "s.price", "s.label")


def trend_state(high_label, low_label):
    known = lambda x: x.isNotNull() & (x != "FIRST")
    pair = lambda h, lo: (high_label == h) & (low_label == lo)
    return (
        F.when(~known(high_label) | ~known(low_label), "INSUFFICIENT_DATA")
        .when(high_label.startswith("EQ") | low_label.startswith("EQ"), "RANGE")
        .when(pair("HH", "HL"), "UPTREND")
        .when(pair("LH", "LL"), "DOWNTREND")
        .when(pair("HH", "LL"), "EXPANSION")
        .otherwise("CONTRACTION")
    )


def structure(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds to bars with atr: swing columns, trend, event_type, event_level, bias, active_high, active_low, last_event.

    A level is the latest confirmed swing. The first close beyond it breaks it: a high first, a low
    only at a bar that breaks no high. A break against the bias that stood is a change of character,
    any other a break of structure. last_event: index, type, level, close of the latest break.
    """
    out = swing_columns(bars, params)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    out = out.select(
        "*",
        trend_state(last("high_label", so_far()), last("low_label", so_far())).alias("trend"),
        F.max(F.when(F.col("swing_high").isNotNull(), F.col("pos"))).over(so_far()).alias("__hid"),
        F.max(F.when(F.col("swing_low").isNotNull(), F.col("pos"))).over(so_far()).alias("__lid"),
        last("swing_high", so_far()).alias("__hp"),
        last("swing_low", so_far()).alias("__lp"),
    )

    def breaks(out: DataFrame, beyond, level: str, name: str) -> DataFrame:
        w = Window.partitionBy(*SERIES, level).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        hit = F.coalesce(beyond, F.lit(False)).cast("int")
        out = out.withColumn("__hit", hit).withColumn("__earlier", F.coalesce(F.sum("__hit").over(w), F.lit(0)))
        return out.withColumn(name, (F.col("__hit") == 1) & (F.col("__earlier") == 0)).withColumn(f"{name}_before", F.col("__earlier") > 0).drop("__hit", "__earlier")

    out = breaks(out, F.col("close") > F.col("__hp"), "__hid", "__up")
    out = breaks(out, (F.col("close") < F.col("__lp")) & ~F.col("__up"), "__lid", "__down")
    out = out.withColumn("__d", F.when(F.col("__up"), "BULLISH").when(F.col("__down"), "BEARISH"))
    out = out.withColumn("__prior", last("__d", before()))
    kind = F.when(F.col("__prior").isNotNull() & (F.col("__prior") != F.col("__d")), "CHOCH_").otherwise("BOS_")
    out = out.select(
        "*",
        F.when(F.col("__d").isNotNull(), F.concat(kind, F.col("__d"))).alias("event_type"),
        F.when(F.col("__up"), F.col("__hp")).when(F.col("__down"), F.col("__lp")).alias("event_level"),
        F.coalesce(last("__d", so_far()), F.lit("NEUTRAL")).alias("bias"),
        F.when(~F.col("__up") & ~F.col("__up_before"), F.col("__hp")).alias("active_high"),
        F.when(~F.col("__down") & ~F.col("__down_before"), F.col("__lp")).alias("active_low"),
    )
    event = F.when(F.col("event_type").isNotNull(), F.struct(F.col("pos").alias("index"), F.col("ts"), F.col("event_type").alias("type"), F.col("event_level").alias("level"), F.col("close")))
    out = out.withColumn("event", event).withColumn("last_event", last("event", so_far()))
    return out.drop("__hid", "__lid", "__hp", "__lp", "__up", "__up_before", "__down", "__down_before", "__d", "__prior")


def structure_events(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """One row for each structure event."""
    return structure(bars, params).filter(F.col("event_type").isNotNull()).select(*SERIES, "pos", "ts", "event_type", F.col("event_level").alias("level"), "close")
