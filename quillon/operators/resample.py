"""Higher timeframes: candles of candles, and the last closed one at each base bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import SERIES
from ..params import HIGHER_TIMEFRAME, EngineParams
from ..sources.tables import numbered
from .indicators import recursions
from .structure import structure


def bucket(ts: Column, rule: str) -> tuple[Column, Column]:
    """(label, end) of the left-closed, left-labelled bucket of a timestamp.

    Weeks start on Sunday. Month buckets are bounded by month ends, so a month's last day belongs to
    the next bucket, labelled with that day.
    """
    day = F.to_date(ts)
    if rule == "1h":
        label = F.date_trunc("hour", ts)
        return label, label + F.expr("INTERVAL 1 HOUR")
    if rule == "4h":
        label = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 14400) * 14400)
        return label, label + F.expr("INTERVAL 4 HOURS")
    if rule == "1D":
        label = F.date_trunc("day", ts)
        return label, label + F.expr("INTERVAL 1 DAY")
    if rule == "1W":
        label = F.date_sub(day, F.dayofweek(day) - 1)
        return label.cast("timestamp"), F.date_add(label, 7).cast("timestamp")
    if rule == "1ME":
        label = F.when(day == F.last_day(day), day).otherwise(F.last_day(F.add_months(day, -1)))
        return label.cast("timestamp"), F.last_day(F.date_add(label, 1)).cast("timestamp")
    raise ValueError(f"unknown rule {rule!r}")


def rule_of(interval: Column) -> Column:
    """The rule of the higher timeframe that an interval is read against; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in HIGHER_TIMEFRAME.items() for x in pair]), interval)


def resample(bars: DataFrame, rule: str | None = None) -> DataFrame:
    """Candles by the rule, or by each series' own; series that have none give none. With period_end, rule, and pos in the series.

    A symbol may have series of several intervals; each is resampled by itself and keeps its interval.
    First and last skip missing prices, a missing volume adds nothing, and a period that lacks a price
    altogether is no candle.
    """
    bars = bars.withColumn("rule", F.lit(rule) if rule else rule_of(F.col("interval"))).filter(F.col("rule").isNotNull())
    label, end = F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")
    for r in [rule] if rule else dict.fromkeys(HIGHER_TIMEFRAME.values()):
        start, stop = bucket(F.col("ts"), r)
        label, end = F.when(F.col("rule") == r, start).otherwise(label), F.when(F.col("rule") == r, stop).otherwise(end)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    grouped = bars.select("*", label.alias("__label"), end.alias("period_end")).groupBy(*SERIES, "rule", F.col("__label").alias("ts"), "period_end")
    prices = {
        "open": F.min_by("open", at("open")),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", at("close")),
    }
    out = grouped.agg(*[price.alias(c) for c, price in prices.items()], F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")).dropna(subset=list(prices))
    return numbered(out).select(*SERIES, "pos", "ts", "open", "high", "low", "close", "volume", "period_end", "rule")


def higher_timeframe(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """The engine on the higher timeframe of each series: one row for each period, with structure and averages.

    A row keeps the series' own interval; rule tells the higher one. A series of no more periods than
    the two sides of a swing and one has no higher timeframe.
    """
    higher = resample(bars)
    enough = F.count(F.lit(1)).over(Window.partitionBy(*SERIES)) > 2 * params.swing_lookback + 1
    return structure(recursions(higher.withColumn("__enough", enough).filter("__enough").drop("__enough"), params), params)


def closed_period(base: DataFrame, higher: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds to each base bar ``htf``: the last higher bar of its series whose end isn't after the bar's own time.

    Both are put on one time line per series, higher bars first at equal times, and the last one seen
    is carried on: a shuffle by series, no range join.
    """
    emas = F.create_map(*[x for n in params.ema_periods for x in (F.lit(str(n)), F.round(f"ema_{n}", params.price_decimals))])
    event = F.when(F.col("last_event").isNotNull(), F.struct(F.col("last_event.type").alias("type"), F.col("last_event.ts").alias("timestamp"), F.round("last_event.level", params.price_decimals).alias("level"), F.round("last_event.close", params.price_decimals).alias("close"), (F.col("pos") - F.col("last_event.index")).alias("bars_ago")))
    snapshot = F.struct(
        F.col("rule").alias("interval"),
        (F.col("pos") + 1).alias("bars_available"),
        F.col("ts").alias("as_of"),
        "trend",
        "bias",
        F.round("close", params.price_decimals).alias("close"),
        F.map_filter(emas, lambda _, v: v.isNotNull()).alias("ema"),
        event.alias("last_event"),
    )
    facts = higher.select(*SERIES, F.col("period_end").alias("ts"), F.lit(0).alias("__tag"), snapshot.alias("__htf"))
    line = base.withColumn("__tag", F.lit(1)).unionByName(facts, allowMissingColumns=True)
    w = Window.partitionBy(*SERIES).orderBy("ts", "__tag", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("htf", F.last("__htf", ignorenulls=True).over(w)).filter(F.col("__tag") == 1).drop("__tag", "__htf")
