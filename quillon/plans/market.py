"""Registered queries of the candle engine: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import stamp
from ..operators import indicators as ind
from ..operators import structure as st
from ..sources import tables
from .sql import BLOCKS, sql

REGISTRY: dict[str, tuple] = {}


def query(statement: str | None):
    def register(f):
        REGISTRY[f.__name__] = (f, statement)
        return f

    return register


def rounded(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


T = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
BAR = "symbol, pos::BIGINT AS pos"


def bar(df: DataFrame, *columns) -> DataFrame:
    return df.select("symbol", F.col("pos").cast("long").alias("pos"), *columns)


def _ohlc(df: DataFrame) -> DataFrame:
    return bar(df, stamp(F.col("ts")).alias("ts"), *rounded("open", "high", "low", "close", "volume"))


@query(sql(f"SELECT {BAR}, {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM bars_1h"))
def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(tables.bars_1h(spark, sf_dir))


@query(sql(f"SELECT {BAR}, {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM bars_1d"))
def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(tables.bars_1d(spark, sf_dir))


@query(sql(f"SELECT {BAR}, round(tr, 6) AS true_range FROM h_tr"))
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.true_range(tables.bars_1h(spark, sf_dir)), *rounded("true_range"))


def _ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.indicators(tables.bars_1h(spark, sf_dir))


@query(sql(f"SELECT {BAR}, {r('return_1', 'return_5', 'return_20')} FROM h_tr"))
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.windowed(tables.bars_1h(spark, sf_dir)), *rounded("return_1", "return_5", "return_20"))


@query(sql(f"SELECT {BAR}, round(CASE WHEN g > 0 THEN ln(g) END, 6) AS log_return FROM h_tr"))
def log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.windowed(tables.bars_1h(spark, sf_dir)), *rounded("log_return"))


@query(sql(f"SELECT {BAR}, {r('realized_vol', digits=4)} FROM h_win"))
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.windowed(tables.bars_1h(spark, sf_dir)), *rounded("realized_vol", digits=4))


@query(sql(f"SELECT {BAR}, {r('volume_ratio', 'volume_zscore')} FROM h_win"))
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.windowed(tables.bars_1h(spark, sf_dir)), *rounded("volume_ratio", "volume_zscore"))


@query(sql(f"SELECT {BAR}, {r('efficiency')} FROM h_win"))
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.windowed(tables.bars_1h(spark, sf_dir)), *rounded("efficiency"))


@query(sql(f"SELECT {BAR}, {r('ema_5', 'ema_20', 'ema_50', 'ema_100', 'ema_200')} FROM h_ind"))
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.recursions(tables.bars_1h(spark, sf_dir)), *rounded("ema_5", "ema_20", "ema_50", "ema_100", "ema_200"))


@query(sql(f"SELECT {BAR}, {r('rsi')} FROM h_ind"))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(ind.recursions(tables.bars_1h(spark, sf_dir)), *rounded("rsi"))


@query(sql(f"SELECT {BAR}, {r('atr', 'atr_pct')} FROM h_ind"))
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(_ind(spark, sf_dir), *rounded("atr", "atr_pct"))


@query(sql(f"SELECT {BAR}, {r('atr_percentile')}, vol_regime FROM h_reg"))
def atr_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(_ind(spark, sf_dir), *rounded("atr_percentile"), "vol_regime")


@query(sql("SELECT symbol, vol_regime, trend_regime, count(*)::BIGINT AS bars FROM h_reg GROUP BY ALL"))
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ind(spark, sf_dir).groupBy("symbol", "vol_regime", "trend_regime").agg(F.count(F.lit(1)).alias("bars"))


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.structure(ind.recursions(tables.bars_1h(spark, sf_dir)))


@query(sql(f"""SELECT symbol, "index"::BIGINT AS "index", confirmed_index::BIGINT AS confirmed_index, {T}, kind, round(price, 6) AS price, label FROM h_swings"""))
def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.swings(ind.recursions(tables.bars_1h(spark, sf_dir)))
    return s.select("symbol", F.col("index").cast("long"), F.col("confirmed_index").cast("long"), stamp(F.col("ts")).alias("ts"), "kind", *rounded("price"), "label")


@query(sql("SELECT symbol, kind, label, count(*)::BIGINT AS swings FROM h_swings GROUP BY ALL"))
def swing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.swings(ind.recursions(tables.bars_1h(spark, sf_dir))).groupBy("symbol", "kind", "label").agg(F.count(F.lit(1)).alias("swings"))


@query(sql(f"SELECT {BAR}, trend, bias, {r('active_high', 'active_low')} FROM h_st"))
def structure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(_structure(spark, sf_dir), "trend", "bias", *rounded("active_high", "active_low"))


@query(sql(f"SELECT {BAR}, {T}, event_type, round(event_level, 6) AS level, {r('close')} FROM h_st WHERE event_type IS NOT NULL"))
def structure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _structure(spark, sf_dir).filter(F.col("event_type").isNotNull())
    return bar(e, stamp(F.col("ts")).alias("ts"), "event_type", F.round("event_level", 6).alias("level"), *rounded("close"))


@query(sql(f"SELECT {BAR}, last_type AS type, {r('last_level')}, (pos - last_index)::BIGINT AS bars_ago FROM h_st"))
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(_structure(spark, sf_dir), F.col("last_event.type").alias("type"), F.round("last_event.level", 6).alias("last_level"), (F.col("pos") - F.col("last_event.index")).cast("long").alias("bars_ago"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import assessed

    return assessed(tables.bars_1h(spark, sf_dir))


def _higher(name: str, base, rule: str) -> None:
    from ..operators.resample import resample

    block = {"1D": "day", "1W": "week", "1ME": "month"}[rule]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = resample(base(spark, sf_dir), rule)
        return bar(df, stamp(F.col("ts")).alias("ts"), stamp(F.col("period_end")).alias("period_end"), *rounded("open", "high", "low", "close", "volume"))

    run.__name__ = name
    query(sql(f"SELECT {BAR}, {T}, strftime(period_end, '%Y-%m-%d %H:%M:%S') AS period_end, {r('open', 'high', 'low', 'close', 'volume')} FROM {block}"))(run)


_higher("bars_htf_1d", tables.bars_1h, "1D")
_higher("bars_htf_1w", tables.bars_1d, "1W")
_higher("bars_htf_1m", tables.bars_1d, "1ME")


@query(sql(f"""SELECT a.symbol, a.pos::BIGINT AS pos, (x.pos + 1)::BIGINT AS bars_available, strftime(x.ts, '%Y-%m-%d %H:%M:%S') AS as_of, x.trend, x.bias, round(x.close, 4) AS close, x.last_type AS last_event
    FROM htf_at a LEFT JOIN dd_st x ON x.symbol = a.symbol AND x.pos = a.hpos"""))
def htf_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resample import closed_period, higher_timeframe

    bars = tables.bars_1h(spark, sf_dir)
    h = F.col("htf")
    return bar(closed_period(bars, higher_timeframe(bars)), h.bars_available.cast("long").alias("bars_available"), stamp(h.as_of).alias("as_of"), h.trend.alias("trend"), h.bias.alias("bias"), h.close.alias("close"), h.last_event.type.alias("last_event"))


@query(sql(f"""SELECT a.symbol, a.interval, a.pos::BIGINT AS pos, CASE WHEN x.pos IS NOT NULL THEN a.rule END AS rule, (x.pos + 1)::BIGINT AS bars_available, strftime(x.ts, '%Y-%m-%d %H:%M:%S') AS as_of,
        x.trend, x.bias, round(x.close, 4) AS close, x.last_type AS last_event
    FROM (SELECT *, '1h' AS "interval", '1D' AS rule FROM htf_at UNION ALL SELECT *, '1d', '1W' FROM week_at UNION ALL SELECT symbol, pos, NULL, '1mo', NULL FROM month) a
    LEFT JOIN (SELECT symbol, '1D' AS rule, pos, ts, trend, bias, close, last_type FROM dd_st UNION ALL SELECT symbol, '1W', pos, ts, trend, bias, close, last_type FROM ww_st) x
    ON x.symbol = a.symbol AND x.rule = a.rule AND x.pos = a.hpos"""))
def htf_every_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed higher period of each bar in a table of series of several intervals."""
    from ..operators.resample import closed_period, higher_timeframe

    bars, h = tables.every_interval(spark, sf_dir), F.col("htf")
    rows = closed_period(bars, higher_timeframe(bars)).withColumn("rule", h.interval)
    return bar(rows, "interval", "rule", h.bars_available.cast("long").alias("bars_available"), stamp(h.as_of).alias("as_of"), h.trend.alias("trend"), h.bias.alias("bias"), h.close.alias("close"), h.last_event.type.alias("last_event"))


@query(sql(f"SELECT {BAR}, id::BIGINT AS id, side, touches::BIGINT AS touches, i0::BIGINT AS first_index, i1::BIGINT AS last_index, {r('price')}, round((price - close) / atr, 6) AS distance_atr FROM lv"))
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.levels import series_levels

    bars = st.swing_columns(ind.recursions(tables.bars_1h(spark, sf_dir)))
    df = bar(series_levels(bars), F.posexplode_outer("levels").alias("id", "v")).filter(F.col("v").isNotNull())
    long = lambda c: F.col(f"v.{c}").cast("long").alias(c)
    return df.select("symbol", "pos", F.col("id").cast("long").alias("id"), "v.side", long("touches"), long("first_index"), long("last_index"), F.round("v.price", 6).alias("price"), F.round("v.distance_atr", 6).alias("distance_atr"))


@query(sql(f"SELECT {BAR}, rule AS name, direction, round(trig, 4) AS trigger_level, round(inval, 4) AS invalidation_level FROM verdicts WHERE met = total"))
def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bar(_assessed(spark, sf_dir), F.explode_outer("setups").alias("s")).filter(F.col("s").isNotNull())
    return df.select("symbol", "pos", "s.name", "s.direction", "s.trigger_level", "s.invalidation_level")


@query(sql(f"SELECT {BAR}, rule || ': ' || met || '/' || total || ' met, missing ' || missing AS near_miss FROM verdicts WHERE met < total AND met / total >= 0.66"))
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(_assessed(spark, sf_dir), F.explode_outer("near_miss_setups").alias("near_miss")).filter(F.col("near_miss").isNotNull())


@query(sql(f"""SELECT {BAR}, list_aggregate(list_transform(w, lambda x: x.c), 'sum').round(2) AS sum_close, len(w)::BIGINT AS candles, strftime(w[1].t, '%Y-%m-%d %H:%M:%S') AS first_ts
    FROM (SELECT symbol, pos, list({{'t': ts, 'c': close}}) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w FROM bars_1h)"""))
def candle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import trailing

    w = F.collect_list(F.struct("ts", "close")).over(trailing(60))
    df = bar(tables.bars_1h(spark, sf_dir).withColumn("w", w), "w")
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.close)
    return df.select("symbol", "pos", F.round(total, 2).alias("sum_close"), F.size("w").cast("long").alias("candles"), stamp(F.get("w", F.lit(0)).ts).alias("first_ts"))


@query(sql(f"""SELECT symbol, pos::BIGINT AS pos, string_agg(kind || ':' || label || '@' || i, ',' ORDER BY i, kind) AS swings FROM
    (SELECT b.symbol, b.pos, s.kind, s.label, s."index" AS i FROM bars_1h b JOIN h_swings s ON s.symbol = b.symbol AND s.confirmed_index <= b.pos
     QUALIFY row_number() OVER (PARTITION BY b.symbol, b.pos ORDER BY s.confirmed_index DESC, s.kind DESC) <= 8) GROUP BY symbol, pos"""))
def recent_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import levels as lv

    bars = st.swing_columns(ind.recursions(tables.bars_1h(spark, sf_dir)))
    df = bar(lv.recent_swings(bars), F.expr("slice(known, greatest(size(known) - 7, 1), 8)").alias("s")).filter(F.size("s") > 0)
    keyed = F.sort_array(F.transform("s", lambda x: F.struct(x["index"].alias("i"), x.kind.alias("k"), x.label.alias("l"))))
    return df.select("symbol", "pos", F.array_join(F.transform(keyed, lambda x: F.concat(x.k, F.lit(":"), x.l, F.lit("@"), x.i.cast("string"))), ",").alias("swings"))


@query(sql(f"""SELECT s.symbol, s.pos::BIGINT AS pos, trend, bias, vol_regime, trend_regime, round(close, 4) AS close, round(rsi, 2) AS rsi, round(atr, 4) AS atr, round(atr_percentile, 4) AS atr_percentile,
    round(efficiency, 4) AS efficiency_ratio, coalesce(n_setups, 0)::BIGINT AS n_setups, coalesce(n_levels, 0)::BIGINT AS n_levels
    FROM facts s LEFT JOIN (SELECT symbol, pos, count(*) AS n_setups FROM verdicts WHERE met = total GROUP BY ALL) USING (symbol, pos) LEFT JOIN (SELECT symbol, pos, count(*) AS n_levels FROM lv GROUP BY ALL) USING (symbol, pos)"""))
def context_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _assessed(spark, sf_dir)
    size = lambda c: F.size(c).cast("long")
    return bar(df, "trend", "bias", "vol_regime", "trend_regime", *rounded("close", digits=4), *rounded("rsi", digits=2), *rounded("atr", "atr_percentile", digits=4), F.round("efficiency", 4).alias("efficiency_ratio"), size("setups").alias("n_setups"), size("levels").alias("n_levels"))


@query(None)
def market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document, as JSON, of 20 evenly strided bars of each series: the context command's own sample."""
    from ..operators.context import context_json, contexts, strided

    bars = tables.bars_1h(spark, sf_dir)
    return bar(context_json(contexts(bars, strided(bars, 20))), "context")


BLOCKS |= {
    "strided": """SELECT symbol, pos FROM (SELECT symbol, pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h)
    WHERE pos >= least(200, n - 1) AND (pos - least(200, n - 1)) % greatest(1, (n - least(200, n - 1)) // 20) = 0 AND (pos - least(200, n - 1)) / greatest(1, (n - least(200, n - 1)) // 20) < 20""",
    "told": """SELECT *, least(8, count(sh) OVER w + count(sl) OVER w) AS n_swings, least(3, count(event_type) OVER w) AS n_events, first_value(ts) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS first_ts
        FROM facts WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


@query(sql("""SELECT s.symbol, s.pos::BIGINT AS pos, strftime(s.ts, '%Y-%m-%dT%H:%M:%S+00:00') AS as_of, (s.pos + 1)::BIGINT AS bars_available, least(60, s.pos + 1)::BIGINT AS candles, strftime(first_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS first_candle,
    round(s.rsi, 2) AS rsi, round(s.atr, 4) AS atr, round(s.ema_50, 4) AS ema_50, s.trend, s.bias, round(s.active_high, 4) AS active_high, n_swings::BIGINT AS n_swings, n_events::BIGINT AS n_events, s.vol_regime, s.trend_regime,
    coalesce(n_levels, 0)::BIGINT AS n_levels, first_level, coalesce(n_setups, 0)::BIGINT AS n_setups, x.trend AS htf_trend, round(x.close, 4) AS htf_close
    FROM strided JOIN told s USING (symbol, pos) LEFT JOIN (SELECT symbol, pos, count(*) AS n_setups FROM verdicts WHERE met = total GROUP BY ALL) USING (symbol, pos)
    LEFT JOIN (SELECT symbol, pos, count(*) AS n_levels, round(min(price), 4) AS first_level FROM lv GROUP BY ALL) USING (symbol, pos) LEFT JOIN htf_at a USING (symbol, pos) LEFT JOIN dd_st x ON x.symbol = a.symbol AND x.pos = a.hpos"""))
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nested documents of market_context say, read from their JSON."""
    at = lambda path, kind="string": F.get_json_object("context", f"$.{path}").cast(kind)
    size = lambda path: F.json_array_length(at(path)).cast("long")
    numbers = {"rsi": "indicators.rsi", "atr": "indicators.atr", "ema_50": "indicators.ema.50", "active_high": "structure.active_swing_high", "first_level": "levels[0].price", "htf_close": "higher_timeframe.close"}
    texts = {"as_of": "as_of", "first_candle": "ohlcv_window[0].t", "trend": "structure.trend", "bias": "structure.bias", "vol_regime": "volatility.regime", "trend_regime": "regime.trend_regime", "htf_trend": "higher_timeframe.trend"}
    sizes = {"candles": "ohlcv_window", "n_swings": "structure.swings", "n_events": "structure.recent_events", "n_levels": "levels", "n_setups": "setups"}
    read = [*[at(p, "double").alias(c) for c, p in numbers.items()], *[at(p).alias(c) for c, p in texts.items()], *[size(p).alias(c) for c, p in sizes.items()]]
    return market_context(spark, sf_dir).select("symbol", "pos", at("bars_available", "long").alias("bars_available"), *read)


#: The default parameters as their fingerprint reads them: fixed values.
DEFAULTS = (
    '{"atr_percentile_min_periods": 60, "atr_percentile_window": 252, "atr_period": 14, "efficiency_window": 20, "ema_periods": [5, 20, 50, 100, 200], '
    '"equal_level_atr": 0.15, "event_recency_bars": 10, "level_cluster_atr": 0.5, "level_min_touches": 2, "level_proximity_atr": 0.5, '
    '"max_levels_per_side": 4, "max_swings_in_context": 8, "ohlcv_window_bars": 60, "price_decimals": 4, "range_er_max": 0.2, "ratio_decimals": 4, '
    '"realized_vol_window": 20, "return_periods": [1, 5, 20], "rsi_period": 14, "setup_fast_ema": 20, "setup_slow_ema": 50, "swing_lookback": 3, '
    '"trend_er_min": 0.35, "volume_sma_window": 20}'
)


@query(sql(f"SELECT symbol, substr(sha256('{DEFAULTS}'), 1, 16) AS params_fingerprint, '1.1.0' AS schema_version, count(*)::BIGINT AS documents FROM strided GROUP BY symbol"))
def context_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters and the schema that every document says it was made with."""
    from ..operators.context import contexts, strided

    bars, c = tables.bars_1h(spark, sf_dir), F.col("context")
    made = contexts(bars, strided(bars, 20)).select("symbol", c.params_fingerprint.alias("params_fingerprint"), c.schema_version.alias("schema_version"))
    return made.groupBy("symbol", "params_fingerprint", "schema_version").agg(F.count(F.lit(1)).alias("documents"))


@query(sql("SELECT symbol, pos::BIGINT AS pos FROM strided"))
def strided_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import strided

    return bar(strided(tables.bars_1h(spark, sf_dir), 20))
