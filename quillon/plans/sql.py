"""Building blocks of the reference SQL: named table expressions that a query pulls in as it needs them."""

from __future__ import annotations

import re

BLOCKS: dict[str, str] = {
    "bars_1h": """SELECT event_type AS symbol, '1h' AS "interval", row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1 AS pos, date_trunc('hour', ts) AS ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
        FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "bars_1d": """SELECT o_orderpriority AS symbol, '1d' AS "interval", row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('day', o_orderdate)) - 1 AS pos, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
        first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume
        FROM orders GROUP BY o_orderpriority, date_trunc('day', o_orderdate)""",
    "dirty": """SELECT symbol, "interval", pos,
        CASE WHEN pos % 97 = 11 THEN lag(ts, 1) OVER w WHEN pos % 101 = 13 THEN lag(ts, 2) OVER w ELSE ts END AS ts,
        CASE WHEN pos % 53 = 7 THEN NULL ELSE open END AS open, CASE WHEN pos % 61 = 9 THEN low - 1 ELSE high END AS high,
        CASE WHEN pos % 67 = 10 THEN close + 1 WHEN pos % 71 = 3 THEN -low ELSE low END AS low, CASE WHEN pos % 59 = 8 THEN NULL ELSE close END AS close,
        CASE WHEN pos % 73 = 5 THEN NULL WHEN pos % 79 = 6 THEN -volume WHEN pos >= 20 AND pos < 32 THEN 0.0 ELSE volume END AS volume
        FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
    # Higher timeframes: label is the bucket's start, period_end its end.
    "day": """SELECT symbol, '1D' AS "interval", row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', ts)) - 1 AS pos, date_trunc('day', ts)::TIMESTAMP AS ts,
        first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS period_end
        FROM bars_1h GROUP BY symbol, date_trunc('day', ts)""",
    "week": """SELECT symbol, '1W' AS "interval", row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS pos, b AS ts,
        first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, b + INTERVAL 7 DAY AS period_end
        FROM (SELECT *, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-04') AS b FROM bars_1d) GROUP BY symbol, b""",
    "month": """SELECT symbol, '1ME' AS "interval", row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS pos, b AS ts,
        first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, last_day(b + INTERVAL 1 DAY)::TIMESTAMP AS period_end
        FROM (SELECT *, CASE WHEN ts::DATE = last_day(ts) THEN ts::DATE ELSE last_day(ts - INTERVAL 1 MONTH) END::TIMESTAMP AS b FROM bars_1d) GROUP BY symbol, b""",
}


def engine_blocks(p: str, bars: str, per_year: int) -> dict[str, str]:
    """The engine over the table expression ``bars``, all names with prefix p."""
    w = "WINDOW w AS (PARTITION BY symbol ORDER BY pos)"
    cum = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    prev = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    W = "OVER (PARTITION BY symbol ORDER BY pos"
    last20 = f"{W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return {
        f"{p}_tr": f"""SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, close - lag(close) OVER w AS d, close / nullif(lag(close) OVER w, 0) AS g,
            {', '.join(f'close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}' for n in (1, 5, 20))} FROM {bars} {w}""",
        f"{p}_atr": f"""SELECT symbol, 13 AS pos, avg(tr) AS v FROM {p}_tr WHERE pos < 14 GROUP BY symbol HAVING count(*) = 14
            UNION ALL SELECT t.symbol, t.pos, r.v + (t.tr - r.v) / 14 FROM {p}_atr r JOIN {p}_tr t ON t.symbol = r.symbol AND t.pos = r.pos + 1""",
        f"{p}_gl": f"""SELECT symbol, 14 AS pos, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM {p}_tr WHERE pos BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
            UNION ALL SELECT t.symbol, t.pos, r.g + (greatest(t.d, 0) - r.g) / 14, r.l + (greatest(-t.d, 0) - r.l) / 14 FROM {p}_gl r JOIN {p}_tr t ON t.symbol = r.symbol AND t.pos = r.pos + 1""",
        f"{p}_ema": f"""SELECT symbol, n, n - 1 AS pos, avg(close) AS v FROM {bars}, (VALUES (5), (20), (50), (100), (200)) x(n) WHERE pos < n GROUP BY symbol, n HAVING count(*) = n
            UNION ALL SELECT t.symbol, r.n, t.pos, r.v + 2.0 / (r.n + 1) * (t.close - r.v) FROM {p}_ema r JOIN {bars} t ON t.symbol = r.symbol AND t.pos = r.pos + 1""",
        f"{p}_emas": f"""SELECT symbol, pos, {', '.join(f'max(v) FILTER (WHERE n = {n}) AS ema_{n}' for n in (5, 20, 50, 100, 200))} FROM {p}_ema GROUP BY symbol, pos""",
        f"{p}_ind": f"""SELECT t.*, a.v AS atr, CASE WHEN gl.l = 0 THEN CASE WHEN gl.g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + gl.g / gl.l) END AS rsi, a.v / nullif(close, 0) AS atr_pct,
            ema_5, ema_20, ema_50, ema_100, ema_200
            FROM {p}_tr t LEFT JOIN {p}_atr a USING (symbol, pos) LEFT JOIN {p}_gl gl USING (symbol, pos) LEFT JOIN {p}_emas USING (symbol, pos)""",
        f"{p}_win": f"""SELECT *, CASE WHEN count(CASE WHEN g > 0 THEN ln(g) END) {last20} = 20 THEN stddev_samp(CASE WHEN g > 0 THEN ln(g) END) {last20} * sqrt({per_year}) END AS realized_vol,
            CASE WHEN count(volume) {last20} = 20 THEN volume / nullif(avg(volume) {last20}, 0) END AS volume_ratio,
            CASE WHEN count(volume) {last20} = 20 THEN (volume - avg(volume) {last20}) / nullif(stddev_samp(volume) {last20}, 0) END AS volume_zscore,
            abs(close - lag(close, 20) {W})) / nullif(CASE WHEN count(d) {last20} = 20 THEN sum(abs(d)) {last20} END, 0) AS efficiency,
            list(atr_pct) FILTER (WHERE atr_pct IS NOT NULL) {W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM {p}_ind""",
        f"{p}_reg": f"""SELECT * EXCLUDE (seen), CASE WHEN efficiency IS NULL THEN 'UNKNOWN' WHEN efficiency >= 0.35 THEN 'TRENDING' WHEN efficiency <= 0.20 THEN 'RANGING' ELSE 'MIXED' END AS trend_regime,
            CASE WHEN atr_percentile IS NULL THEN 'UNKNOWN' WHEN atr_percentile < 0.25 THEN 'LOW' WHEN atr_percentile < 0.75 THEN 'NORMAL' WHEN atr_percentile < 0.90 THEN 'HIGH' ELSE 'EXTREME' END AS vol_regime
            FROM (SELECT *, CASE WHEN atr_pct IS NOT NULL AND len(seen) >= 60 THEN (len(list_filter(seen, lambda v: v < atr_pct)) + (len(list_filter(seen, lambda v: v = atr_pct)) + 1) / 2.0) / len(seen) END AS atr_percentile FROM {p}_win)""",
        f"{p}_sw0": f"""SELECT *, lag(atr, 3) OVER w AS swing_atr, lag(ts, 3) OVER w AS swing_ts,
            CASE WHEN pos >= 6 AND lag(high, 3) OVER w > max(high) {W} ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AND lag(high, 3) OVER w >= max(high) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) THEN lag(high, 3) OVER w END AS sh,
            CASE WHEN pos >= 6 AND lag(low, 3) OVER w < min(low) {W} ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AND lag(low, 3) OVER w <= min(low) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) THEN lag(low, 3) OVER w END AS sl
            FROM {p}_ind {w}""",
        f"{p}_sw1": f"""SELECT *, last_value(sh IGNORE NULLS) {W} {prev}) AS psh, last_value(sl IGNORE NULLS) {W} {prev}) AS psl FROM {p}_sw0""",
        f"{p}_sw": f"""SELECT *, CASE WHEN sh IS NULL THEN NULL WHEN psh IS NULL THEN 'FIRST' WHEN abs(sh - psh) <= coalesce(swing_atr, 0) * 0.15 THEN 'EQH' WHEN sh > psh THEN 'HH' ELSE 'LH' END AS hl,
            CASE WHEN sl IS NULL THEN NULL WHEN psl IS NULL THEN 'FIRST' WHEN abs(sl - psl) <= coalesce(swing_atr, 0) * 0.15 THEN 'EQL' WHEN sl > psl THEN 'HL' ELSE 'LL' END AS ll FROM {p}_sw1""",
        f"{p}_swings": f"""SELECT symbol, pos - 3 AS "index", pos AS confirmed_index, swing_ts AS ts, 'HIGH' AS kind, sh AS price, hl AS label FROM {p}_sw WHERE sh IS NOT NULL
            UNION ALL SELECT symbol, pos - 3, pos, swing_ts, 'LOW', sl, ll FROM {p}_sw WHERE sl IS NOT NULL""",
        f"{p}_st0": f"""SELECT *, last_value(hl IGNORE NULLS) {W} {cum}) AS lh, last_value(ll IGNORE NULLS) {W} {cum}) AS lll,
            max(CASE WHEN sh IS NOT NULL THEN pos END) {W} {cum}) AS hid, max(CASE WHEN sl IS NOT NULL THEN pos END) {W} {cum}) AS lid,
            last_value(sh IGNORE NULLS) {W} {cum}) AS hp, last_value(sl IGNORE NULLS) {W} {cum}) AS lp FROM {p}_sw""",
        f"{p}_st1": f"""SELECT *, coalesce(pos = min(CASE WHEN close > hp THEN pos END) OVER (PARTITION BY symbol, hid), false) AS is_h, min(CASE WHEN close > hp THEN pos END) OVER (PARTITION BY symbol, hid) AS hbrk FROM {p}_st0""",
        f"{p}_st2": f"""SELECT *, coalesce(pos = min(CASE WHEN close < lp AND NOT is_h THEN pos END) OVER (PARTITION BY symbol, lid), false) AS is_l, min(CASE WHEN close < lp AND NOT is_h THEN pos END) OVER (PARTITION BY symbol, lid) AS lbrk FROM {p}_st1""",
        f"{p}_st3": f"""SELECT *, CASE WHEN is_h THEN 'BULLISH' WHEN is_l THEN 'BEARISH' END AS dir FROM {p}_st2""",
        f"{p}_st4": f"""SELECT *, last_value(dir IGNORE NULLS) {W} {prev}) AS prior, coalesce(last_value(dir IGNORE NULLS) {W} {cum}), 'NEUTRAL') AS bias,
            CASE WHEN lh IS NULL OR lll IS NULL OR lh = 'FIRST' OR lll = 'FIRST' THEN 'INSUFFICIENT_DATA' WHEN lh[:2] = 'EQ' OR lll[:2] = 'EQ' THEN 'RANGE' WHEN lh = 'HH' AND lll = 'HL' THEN 'UPTREND'
                 WHEN lh = 'LH' AND lll = 'LL' THEN 'DOWNTREND' WHEN lh = 'HH' AND lll = 'LL' THEN 'EXPANSION' ELSE 'CONTRACTION' END AS trend,
            CASE WHEN hp IS NOT NULL AND (hbrk IS NULL OR pos < hbrk) THEN hp END AS active_high, CASE WHEN lp IS NOT NULL AND (lbrk IS NULL OR pos < lbrk) THEN lp END AS active_low FROM {p}_st3""",
        f"{p}_st5": f"""SELECT *, CASE WHEN dir IS NOT NULL THEN CASE WHEN prior IS NOT NULL AND prior <> dir THEN 'CHOCH_' ELSE 'BOS_' END || dir END AS event_type, CASE WHEN is_h THEN hp WHEN is_l THEN lp END AS event_level FROM {p}_st4""",
        f"{p}_st": f"""SELECT *, last_value(CASE WHEN event_type IS NOT NULL THEN pos END IGNORE NULLS) {W} {cum}) AS last_index, last_value(event_type IGNORE NULLS) {W} {cum}) AS last_type,
            last_value(event_level IGNORE NULLS) {W} {cum}) AS last_level, last_value(CASE WHEN event_type IS NOT NULL THEN close END IGNORE NULLS) {W} {cum}) AS last_close FROM {p}_st5""",
    }


BLOCKS |= engine_blocks("h", "bars_1h", 1638) | engine_blocks("d", "bars_1d", 252) | engine_blocks("dd", "day", 252)

_NAME = re.compile(r"[a-z_0-9]+")


def sql(select: str, **own: str) -> str:
    """A statement with the table expressions that it names; own: further ones of its own."""
    blocks, order, seen = BLOCKS | own, [], set()

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in blocks and name not in seen:
                seen.add(name)
                need(blocks[name])
                order.append(name)

    need(select)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({blocks[name]})" for name in order) + "\n" + select

# Levels: the clusters of every bar, one swing at a time in ascending order of price.
BLOCKS |= {
    "lv_in": """SELECT b.symbol, b.pos, b.close, b.atr, s.price, s."index" AS i, row_number() OVER (PARTITION BY b.symbol, b.pos ORDER BY s.price, s."index", s.kind) AS rn
        FROM h_ind b JOIN h_swings s ON s.symbol = b.symbol AND s.confirmed_index <= b.pos WHERE b.atr > 0""",
    "lv_fold": """SELECT symbol, pos, close, atr, rn, 1 AS cluster, price AS total, 1 AS n, i AS i0, i AS i1 FROM lv_in WHERE rn = 1
        UNION ALL SELECT x.symbol, x.pos, x.close, x.atr, x.rn, CASE WHEN j THEN cluster ELSE cluster + 1 END, CASE WHEN j THEN total + price ELSE price END, CASE WHEN j THEN n + 1 ELSE 1 END,
               CASE WHEN j THEN least(i0, i) ELSE i END, CASE WHEN j THEN greatest(i1, i) ELSE i END
        FROM (SELECT f.cluster, f.total, f.n, f.i0, f.i1, t.*, abs(t.price - f.total / f.n) <= t.atr * 0.5 AS j FROM lv_fold f JOIN lv_in t ON t.symbol = f.symbol AND t.pos = f.pos AND t.rn = f.rn + 1) x""",
    "lv_all": """SELECT symbol, pos, close, atr, total / n AS price, n AS touches, i0, i1, CASE WHEN total / n > close THEN 'RESISTANCE' ELSE 'SUPPORT' END AS side
        FROM lv_fold QUALIFY row_number() OVER (PARTITION BY symbol, pos, cluster ORDER BY rn DESC) = 1 AND n >= 2""",
    "lv": """SELECT *, row_number() OVER (PARTITION BY symbol, pos ORDER BY price) - 1 AS id FROM
        (SELECT * FROM lv_all QUALIFY row_number() OVER (PARTITION BY symbol, pos, side ORDER BY CASE WHEN side = 'SUPPORT' THEN -price ELSE price END) <= 4)""",
    "near_lv": """SELECT symbol, pos, max(price) FILTER (WHERE side = 'SUPPORT') AS sup, arg_max(touches, price) FILTER (WHERE side = 'SUPPORT') AS sup_n,
        min(price) FILTER (WHERE side = 'RESISTANCE') AS res, arg_min(touches, price) FILTER (WHERE side = 'RESISTANCE') AS res_n FROM lv GROUP BY symbol, pos""",
    "facts": """SELECT s.*, r.trend_regime, r.vol_regime, r.atr_percentile, r.efficiency, sup, sup_n, res, res_n, (s.pos - last_index <= 10) AS fresh
        FROM h_st s JOIN h_reg r USING (symbol, pos) LEFT JOIN near_lv USING (symbol, pos)""",
    "tests": """
        SELECT symbol, pos, k, rule, direction, trig, inval, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (
        SELECT symbol, pos, 1 AS k, 'TREND_CONTINUATION_LONG' AS rule, 'LONG' AS direction, active_high AS trig, active_low AS inval, [
            {'c': 'trend is UPTREND', 'ok': trend = 'UPTREND'}, {'c': 'bias is BULLISH', 'ok': bias = 'BULLISH'}, {'c': 'close pulled back to or below the 20 EMA', 'ok': close <= ema_20 + 0.25 * atr},
            {'c': 'close still above the 50 EMA', 'ok': close > ema_50}, {'c': 'RSI below 65 (not extended)', 'ok': rsi < 65}] AS t FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 2, 'TREND_CONTINUATION_SHORT', 'SHORT', active_low, active_high, [
            {'c': 'trend is DOWNTREND', 'ok': trend = 'DOWNTREND'}, {'c': 'bias is BEARISH', 'ok': bias = 'BEARISH'}, {'c': 'close rallied to or above the 20 EMA', 'ok': close >= ema_20 - 0.25 * atr},
            {'c': 'close still below the 50 EMA', 'ok': close < ema_50}, {'c': 'RSI above 35 (not extended)', 'ok': rsi > 35}] FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 3, 'RANGE_FADE_LONG', 'LONG', sup, sup - atr, [
            {'c': 'regime is RANGING', 'ok': trend_regime = 'RANGING'}, {'c': 'structure is RANGE or CONTRACTION', 'ok': trend IN ('RANGE', 'CONTRACTION')}, {'c': 'price is at a support level', 'ok': abs(close - sup) <= 0.5 * atr},
            {'c': 'support has 2+ touches', 'ok': sup_n >= 2}, {'c': 'RSI below 45', 'ok': rsi < 45}] FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 4, 'RANGE_FADE_SHORT', 'SHORT', res, res + atr, [
            {'c': 'regime is RANGING', 'ok': trend_regime = 'RANGING'}, {'c': 'structure is RANGE or CONTRACTION', 'ok': trend IN ('RANGE', 'CONTRACTION')}, {'c': 'price is at a resistance level', 'ok': abs(close - res) <= 0.5 * atr},
            {'c': 'resistance has 2+ touches', 'ok': res_n >= 2}, {'c': 'RSI above 55', 'ok': rsi > 55}] FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 5, 'VOLATILITY_BREAKOUT_LONG', 'LONG', last_level, active_low, [
            {'c': 'volatility was LOW before the break', 'ok': vol_regime = 'LOW'}, {'c': 'structure was coiling (CONTRACTION or RANGE)', 'ok': trend IN ('RANGE', 'CONTRACTION')},
            {'c': 'a bullish break occurred recently', 'ok': fresh AND last_type IN ('BOS_BULLISH', 'CHOCH_BULLISH')}, {'c': 'close is above the broken level', 'ok': close > last_level}] FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 6, 'REVERSAL_LONG', 'LONG', last_level, active_low, [
            {'c': 'a bullish CHoCH occurred recently', 'ok': fresh AND last_type = 'CHOCH_BULLISH'}, {'c': 'close holds above the broken level', 'ok': close > last_level}, {'c': 'RSI has recovered above 45', 'ok': rsi > 45}] FROM facts WHERE atr IS NOT NULL
        UNION ALL SELECT symbol, pos, 7, 'REVERSAL_SHORT', 'SHORT', last_level, active_high, [
            {'c': 'a bearish CHoCH occurred recently', 'ok': fresh AND last_type = 'CHOCH_BEARISH'}, {'c': 'close holds below the broken level', 'ok': close < last_level}, {'c': 'RSI has rolled below 55', 'ok': rsi < 55}] FROM facts WHERE atr IS NOT NULL)""",
    "verdicts": """SELECT symbol, pos, k, rule, direction, trig, inval, count(*) AS total, count(*) FILTER (WHERE coalesce(t.ok, false)) AS met,
        string_agg(t.c, '; ' ORDER BY i) FILTER (WHERE NOT coalesce(t.ok, false)) AS missing FROM tests GROUP BY ALL""",
    "htf_at": """SELECT b.symbol, b.pos, max(x.pos) AS hpos FROM bars_1h b LEFT JOIN (SELECT * FROM day QUALIFY count(*) OVER (PARTITION BY symbol) > 7) x ON x.symbol = b.symbol AND x.period_end <= b.ts GROUP BY b.symbol, b.pos""",
}

# Series of several intervals: hourly and daily candles of a symbol, daily ones of orders, and monthly ones, which have no higher timeframe.
BLOCKS |= {
    "every_1d": """SELECT symbol, pos, ts, open, high, low, close, volume FROM bars_1d UNION ALL SELECT symbol, pos, ts, open, high, low, close, volume FROM day""",
    "every_1w": """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS pos, b AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
        sum(volume) AS volume, b + INTERVAL 7 DAY AS period_end FROM (SELECT *, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-04') AS b FROM every_1d) GROUP BY symbol, b""",
    "week_at": """SELECT b.symbol, b.pos, max(x.pos) AS hpos FROM every_1d b LEFT JOIN (SELECT * FROM every_1w QUALIFY count(*) OVER (PARTITION BY symbol) > 7) x ON x.symbol = b.symbol AND x.period_end <= b.ts GROUP BY b.symbol, b.pos""",
} | engine_blocks("ww", "every_1w", 52)
