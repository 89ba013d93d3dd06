"""The context document of a bar: everything the engine knows there, nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import SERIES, iso8601, so_far, trailing
from ..params import CONTEXT_SCHEMA_VERSION, ENGINE_VERSION, EngineParams
from .indicators import indicators
from .levels import levels, recent_swings, series_levels, swing_rows
from .resample import closed_period, higher_timeframe
from .setups import setups
from .structure import structure

DISCLAIMER = "Descriptive output for education and research; not trading advice."


def described(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Every bar with indicators, structure, the closed higher period, levels and setups."""
    return closed_period(assessed(bars, params), higher_timeframe(bars, params), params)


def assessed(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Every bar with indicators, structure, levels and setups: what its own interval tells."""
    return setups(series_levels(structure(indicators(bars, params), params), params), params)


def _measured(bars: DataFrame, params: EngineParams) -> DataFrame:
    return closed_period(structure(indicators(bars, params), params), higher_timeframe(bars, params), params)


def strided(bars: DataFrame, count: int, warm_up: int = 200) -> DataFrame:
    """The positions of ``count`` evenly strided bars of each series, from the warm-up on."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    start = F.least(F.lit(warm_up), n - 1)
    step = F.greatest(F.lit(1), F.floor((n - start) / count))
    k = F.col("pos") - start
    return bars.select(*SERIES, "pos", ((k >= 0) & (k % step == 0) & (k / step < count)).alias("take")).filter("take").drop("take")


def at_bar(bars: DataFrame, index: int) -> DataFrame:
    """The position of one bar of each series; a negative index counts from the end, and a series without it has none."""
    wanted = F.lit(index) if index >= 0 else F.count(F.lit(1)).over(Window.partitionBy(*SERIES)) + index
    return bars.select(*SERIES, "pos", wanted.alias("wanted")).filter("pos = wanted").drop("wanted")


def _present(pairs: list[tuple[str, Column]]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def contexts(bars: DataFrame, chosen: DataFrame | None = None, params: EngineParams = EngineParams()) -> DataFrame:
    """symbol, interval, pos, context (a struct) for the chosen bars, or all.

    With chosen bars, known swings, levels and setups upon them and the candle windows are built for
    these alone, from equi-joins by series and by bar.
    """
    p, r = params.price_decimals, params.ratio_decimals
    rows = _measured(bars, params)
    candle = F.struct(iso8601(F.col("ts")).alias("t"), *[F.round(c, p).alias(k) for k, c in zip("ohlc", ("open", "high", "low", "close"), strict=True)], F.when(F.col("has_volume"), F.round("volume", 2)).alias("v"))
    rows = rows.withColumn("__k", F.count("event").over(so_far()))
    last_three = Window.partitionBy(*SERIES).orderBy("__k").rangeBetween(-2, 0)
    rows = rows.withColumn("events", F.collect_list("event").over(last_three))
    if chosen is None:
        rows = series_levels(recent_swings(rows, params).withColumn("window", F.collect_list(candle).over(trailing(params.ohlcv_window_bars))), params)
    else:
        wanted = chosen.select(*SERIES, "pos").distinct()
        swings = swing_rows(rows, params).join(wanted.withColumnRenamed("pos", "__at"), list(SERIES)).filter(F.col("s.confirmed_index") <= F.col("__at"))
        known = swings.groupBy(*SERIES, F.col("__at").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("s.confirmed_index", "s.kind", "s"))).alias("__s"))
        known = known.select(*SERIES, "pos", F.transform("__s", lambda x: x.s).alias("known"))
        near = wanted.select(*SERIES, F.col("pos").alias("__at"), F.explode(F.sequence(F.col("pos") - params.ohlcv_window_bars + 1, F.col("pos"))).alias("pos"))
        windows = rows.select(*SERIES, "pos", candle.alias("c")).join(near, [*SERIES, "pos"]).groupBy(*SERIES, "__at").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("__c"))
        windows = windows.select(*SERIES, F.col("__at").alias("pos"), F.transform("__c", lambda x: x.c).alias("window"))
        rows = rows.join(wanted, [*SERIES, "pos"], "left_semi").join(known, [*SERIES, "pos"], "left").join(windows, [*SERIES, "pos"], "left")
        rows = rows.withColumn("known", F.coalesce("known", F.array().cast(known.schema["known"].dataType)))
        rows = levels(rows, params)
    rows = setups(rows, params)
    reference = lambda e: F.when(e.isNotNull(), F.struct(e["type"].alias("type"), iso8601(e.ts).alias("timestamp"), F.round(e.level, p).alias("level"), F.round(e.close, p).alias("close"), (F.col("pos") - e["index"]).alias("bars_ago")))
    recent = F.slice("known", F.greatest(F.size("known") - params.max_swings_in_context + 1, F.lit(1)), F.lit(params.max_swings_in_context))
    by_index = F.array_sort(recent, lambda a, b: F.when(a["index"] != b["index"], a["index"] - b["index"]).when(a.kind < b.kind, -1).when(a.kind > b.kind, 1).otherwise(0))
    swing = lambda s, i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("id"), s["index"].alias("index"), iso8601(s.timestamp).alias("timestamp"), F.round(s.price, p).alias("price"), s.kind.alias("kind"), s.label.alias("label"), s.confirmed_index.alias("confirmed_index"), (F.col("pos") - s["index"]).alias("bars_ago"))
    level = lambda v, i: F.struct(F.concat(F.lit("L"), i.cast("string")).alias("id"), F.round(v.price, p).alias("price"), v.side.alias("side"), v.touches.alias("touches"), F.round(v.distance_atr, r).alias("distance_atr"), v.last_index.alias("last_index"))
    h = F.col("htf")
    higher = F.when(h.isNotNull(), F.struct(h.interval.alias("interval"), h.bars_available.alias("bars_available"), iso8601(h.as_of).alias("as_of"), h.trend.alias("trend"), h.bias.alias("bias"), h.close.alias("close"), h.ema.alias("ema"), F.when(h.last_event.isNotNull(), h.last_event.withField("timestamp", iso8601(h.last_event.timestamp))).alias("last_event")))
    usable = lambda c: F.when(F.col("has_volume"), F.round(c, r))
    context = F.struct(
        F.lit(CONTEXT_SCHEMA_VERSION).alias("schema_version"),
        F.lit(ENGINE_VERSION).alias("engine_version"),
        F.lit(params.fingerprint()).alias("params_fingerprint"),
        "symbol",
        "interval",
        iso8601(F.col("ts")).alias("as_of"),
        F.col("pos").cast("int").alias("bar_index"),
        (F.col("pos") + 1).cast("int").alias("bars_available"),
        F.col("window").alias("ohlcv_window"),
        F.struct(
            _present([(str(n), F.round(f"ema_{n}", p)) for n in params.ema_periods]).alias("ema"),
            F.round("rsi", 2).alias("rsi"),
            F.round("atr", p).alias("atr"),
            F.round("atr_pct", 6).alias("atr_pct"),
            _present([(str(n), F.round(f"return_{n}", r)) for n in params.return_periods]).alias("returns"),
            F.round("realized_vol", r).alias("realized_volatility"),
            _present([(str(n), F.round(F.try_divide(F.col("close") - F.col(f"ema_{n}"), F.col("atr")), r)) for n in params.ema_periods]).alias("close_vs_ema"),
            usable("volume_ratio").alias("volume_ratio"),
            usable("volume_zscore").alias("volume_zscore"),
        ).alias("indicators"),
        F.struct(
            "trend",
            "bias",
            F.transform(by_index, swing).alias("swings"),
            reference(F.col("last_event")).alias("last_event"),
            F.transform("events", reference).alias("recent_events"),
            F.round("active_high", p).alias("active_swing_high"),
            F.round("active_low", p).alias("active_swing_low"),
        ).alias("structure"),
        F.transform("levels", level).alias("levels"),
        F.struct(F.round("atr", p).alias("atr"), F.round("atr_pct", 6).alias("atr_pct"), F.round("atr_percentile", 4).alias("atr_percentile"), F.col("vol_regime").alias("regime")).alias("volatility"),
        F.struct("trend_regime", F.round("efficiency", 4).alias("efficiency_ratio")).alias("regime"),
        higher.alias("higher_timeframe"),
        "setups",
        "near_miss_setups",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
    return rows.select(*SERIES, "pos", context.alias("context"))


def context_json(rows: DataFrame) -> DataFrame:
    """The context as JSON text; absent values are left out."""
    return rows.withColumn("context", F.to_json("context"))
