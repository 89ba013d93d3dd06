"""Engine semantics on small fixtures: recursions, swings, structure, levels, causality, the gate."""

from __future__ import annotations

import datetime as dt
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import indicators as ind
from quillon.operators import levels as lv
from quillon.operators import resample as rs
from quillon.functions import ranks
from quillon.operators import sampler, structure, summary, validate, views
from quillon.operators.context import context_json, contexts, described, strided
from quillon.params import EngineParams, Thresholds, from_mapping

SCHEMA = "symbol string, interval string, pos int, ts timestamp, open double, high double, low double, close double, volume double"
FAST = EngineParams(ema_periods=(5, 10), rsi_period=5, atr_period=5, return_periods=(1, 5), realized_vol_window=5, volume_sma_window=5, swing_lookback=2, atr_percentile_window=30, atr_percentile_min_periods=10, efficiency_window=5, setup_fast_ema=5, setup_slow_ema=10)


def business_days(n, start=dt.datetime(2024, 1, 1)):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def clean_daily(n=120, symbol="CLEAN"):
    rng, price, rows = random.Random(42), 100.0, []
    for i, day in enumerate(business_days(n)):
        open_ = price * (1 + rng.gauss(0, 0.0008))
        close = price * math.exp(rng.gauss(0, 0.004))
        spread = abs(rng.gauss(0.004, 0.001)) * close
        rows.append([symbol, "1d", i, day, open_, max(open_, close) + spread, min(open_, close) - spread, close, float(rng.randrange(10**6, 5 * 10**6))])
        price = close
    return rows


def from_closes(closes, symbol="Z", highs=None):
    days, rows = business_days(len(closes), dt.datetime(2020, 1, 1)), []
    for i, (day, close) in enumerate(zip(days, closes, strict=True)):
        open_ = closes[i - 1] if i else close
        rows.append([symbol, "1d", i, day, float(open_), max(open_, close) + 0.5 if highs is None else float(highs[i]), min(open_, close) - 0.5, float(close), 1e6])
    return rows


def zigzag(points, steps=6):
    out = [float(points[0])]
    for a, b in zip(points, points[1:], strict=False):
        out += [a + (b - a) * k / steps for k in range(1, steps + 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


# ------------------------------------------------------------- indicators


@pytest.mark.parametrize("n", [1, 3, 14])
def test_seeded_recursion(n):
    rng = np.random.default_rng(n)
    x = rng.normal(100, 5, 60)
    x[:2] = np.nan
    alpha = 2 / (n + 1)
    got, previous = ind.seeded(x, n, alpha), None
    for i, v in enumerate(x):
        if i < n + 1:
            assert np.isnan(got[i])
            continue
        previous = np.mean(x[2 : n + 2]) if previous is None else alpha * v + (1 - alpha) * previous
        assert got[i] == pytest.approx(previous, rel=1e-12)
    broken = x.copy()
    broken[40] = np.nan
    assert np.isnan(ind.seeded(broken, n, alpha)[40:]).all()


def test_rsi_limits():
    assert np.nanmin(ind.relative_strength(np.arange(1.0, 40), 14)) == 100
    assert np.isnan(ind.relative_strength(np.full(40, 5.0), 14)).all()
    assert int(np.flatnonzero(~np.isnan(ind.relative_strength(np.random.default_rng(0).normal(10, 1, 40), 14)))[0]) == 14


def test_true_range_and_efficiency(spark):
    rows = from_closes([100 + i for i in range(12)])
    rows[0][5:8], rows[1][5:8] = [10.0, 9.0, 9.5], [12.0, 11.5, 11.8]
    got = ind.windowed(ind.true_range(frame(spark, rows)), FAST).orderBy("pos").collect()
    assert got[0]["true_range"] == 1.0 and got[1]["true_range"] == 2.5
    assert got[11]["efficiency"] == pytest.approx(1.0)
    assert got[4]["efficiency"] is None


def test_parameters():
    with pytest.raises(ValueError):
        EngineParams(setup_fast_ema=21)
    with pytest.raises(ValueError):
        from_mapping(EngineParams, {"no_such": 1})
    assert from_mapping(Thresholds, {"max_holiday_business_days": 4}).max_holiday_business_days == 4
    assert EngineParams().fingerprint() != FAST.fingerprint() and len(FAST.fingerprint()) == 16


# ------------------------------------------------------ swings, structure


def test_plateau_prints_once(spark):
    rows = from_closes([100, 101, 105, 105, 101, 100, 99], highs=[101, 102, 110, 110, 102, 101, 100])
    got = structure.swings(frame(spark, rows).withColumn("atr", F.lit(None).cast("double")), FAST).filter("kind = 'HIGH'").collect()
    assert [(r["index"], r["confirmed_index"]) for r in got] == [(2, 4)]


def fold(rows, k, atrs):
    """Structure by a plain loop over bars."""
    highs, lows, closes = [r[5] for r in rows], [r[6] for r in rows], [r[7] for r in rows]
    bias, live, out = "NEUTRAL", {}, []
    for i in range(len(rows)):
        c = i - k
        if c >= k:
            if all(highs[c] > highs[j] for j in range(c - k, c)) and all(highs[c] >= highs[j] for j in range(c + 1, i + 1)):
                live["high"] = highs[c]
            if all(lows[c] < lows[j] for j in range(c - k, c)) and all(lows[c] <= lows[j] for j in range(c + 1, i + 1)):
                live["low"] = lows[c]
        side = "high" if "high" in live and closes[i] > live["high"] else "low" if "low" in live and closes[i] < live["low"] else None
        if side:
            way = "BULLISH" if side == "high" else "BEARISH"
            out.append((i, ("CHOCH_" if bias not in ("NEUTRAL", way) else "BOS_") + way, live.pop(side)))
            bias = way
    return out


@pytest.mark.parametrize("seed", range(4))
def test_structure_is_the_fold(spark, seed):
    rng = random.Random(seed)
    closes = [100.0]
    for _ in range(250):
        closes.append(closes[-1] + rng.gauss(0, 1.5))
    rows = from_closes(closes)
    bars = frame(spark, rows).withColumn("atr", F.lit(1.0))
    got = [(r["pos"], r["event_type"], r["level"]) for r in structure.structure_events(bars, FAST).orderBy("pos").collect()]
    assert got == fold(rows, 2, None) and len(got) > 3


def test_zigzag_breaks_and_changes(spark):
    bars = frame(spark, from_closes(zigzag([100, 112, 104, 130, 116, 90]))).withColumn("atr", F.lit(1.0))
    kinds = [r["event_type"] for r in structure.structure_events(bars, FAST).orderBy("pos").collect()]
    assert kinds[0] == "BOS_BULLISH" and "CHOCH_BEARISH" in kinds


def test_level_clusters(spark):
    swings = [(100.0, 1), (100.4, 2), (99.8, 3), (130.0, 4)]
    known = F.array(*[F.struct(F.lit(i).alias("index"), F.lit("HIGH").alias("kind"), F.lit(p).alias("price")) for p, i in swings])
    got = lv.levels(spark.range(1).select(known.alias("known"), F.lit(90.0).alias("close"), F.lit(2.0).alias("atr"))).first()["levels"]
    assert len(got) == 1 and got[0]["touches"] == 3 and got[0]["side"] == "RESISTANCE" and got[0]["price"] == pytest.approx(100.0667, abs=1e-4)
    assert lv.levels(spark.range(1).select(known.alias("known"), F.lit(90.0).alias("close"), F.lit(None).cast("double").alias("atr"))).first()["levels"] == []


def test_levels_of_a_series_are_those_of_each_bar(spark):
    """One walk over a series' swings against a fold of the swings known at each bar; steps of a half make equal prices and equal gaps."""
    rng, closes = random.Random(4), [100.0]
    for _ in range(399):
        closes.append(closes[-1] + rng.choice((-2, -1, -0.5, 0.5, 1, 2)))
    bars = structure.swing_columns(ind.recursions(ind.true_range(frame(spark, from_closes(closes))), FAST), FAST)
    got = lv.series_levels(bars, FAST)
    assert [c for c in got.columns if c not in bars.columns] == ["levels"]
    folded, sides = 0, set()
    rows = got.orderBy("pos").collect()
    prices = [(r[side], r["pos"] - FAST.swing_lookback, r["pos"]) for r in rows for side in ("swing_high", "swing_low") if r[side] is not None]
    for r in rows:
        clusters, made = [], []
        for price, index, at in sorted(prices):
            if at > r["pos"] or r["atr"] is None:
                continue
            if made and abs(price - sum(p for p, _ in made) / len(made)) <= r["atr"] * FAST.level_cluster_atr:
                made.append((price, index))
            else:
                made = [(price, index)]
                clusters.append(made)
        kept = [(sum(p for p, _ in c) / len(c), len(c), min(i for _, i in c), max(i for _, i in c)) for c in clusters if len(c) >= FAST.level_min_touches]
        most = FAST.max_levels_per_side
        want = [c for c in kept if c[0] <= r["close"]][-most:] + [c for c in kept if c[0] > r["close"]][:most]
        assert [(v["price"], v["touches"], v["first_index"], v["last_index"]) for v in r["levels"]] == [pytest.approx(c) for c in want]
        folded += len(want)
        sides |= {v["side"] for v in r["levels"]}
    assert folded > 400 and sides == {"SUPPORT", "RESISTANCE"}


def test_levels_of_no_rows_nulls_and_clashing_names(spark):
    rows = from_closes([100.0, 101.0, 102.0])
    rows[1][7] = None
    bars = structure.swing_columns(ind.recursions(ind.true_range(frame(spark, rows)), FAST), FAST)
    assert lv.series_levels(bars.filter("false"), FAST).collect() == []
    got = lv.series_levels(bars.withColumn("total", F.lit("x")).withColumn("price", F.lit(None).cast("double")), FAST).orderBy("pos").collect()
    assert [(r["levels"], r["total"], r["price"]) for r in got] == [([], "x", None)] * 3


def test_truncation_invariance(spark):
    """What is known at a bar doesn't change when later bars arrive."""
    rng, closes = random.Random(9), [100.0]
    for _ in range(259):
        closes.append(closes[-1] * math.exp(rng.gauss(0, 0.02)))
    rows = from_closes(closes)
    whole = {r["pos"]: r["context"] for r in context_json(contexts(frame(spark, rows), params=FAST)).collect()}
    for n in (91, 143, 247):
        part = {r["pos"]: r["context"] for r in context_json(contexts(frame(spark, rows[:n]), params=FAST)).collect()}
        assert part[n - 1] == whole[n - 1] and part[n // 2] == whole[n // 2]
    assert "NaN" not in whole[259] and '"higher_timeframe"' in whole[259]


def folded(x, n, alpha):
    """The recursion one bar at a time."""
    out, state, run = [], None, []
    for v in x:
        if state is None:
            run = [*run, v] if math.isfinite(v) else []
            state = sum(run[-n:]) / n if len(run) >= n else None
        else:
            state = alpha * v + (1 - alpha) * state if math.isfinite(v) else math.nan
        out.append(math.nan if state is None else state)
    return np.array(out)


#: Bars of a series and those whose close is missing: seeds and gaps before, at and after the borders of blocks of 64 bars.
GAPS = {"none": (640, ()), "late seed": (500, (3, 60, 61, 62, 63, 64)), "never": (400, tuple(range(2, 400, 9))), "one block": (64, ()), "broken at border": (300, (64,)), "broken later": (300, (200,)), "one bar": (1, ()), "two blocks": (128, ()), "first of a block missing": (200, tuple(range(0, 129)))}


def test_recursions_in_blocks(spark):
    """A series in blocks gives what a fold over the whole series gives."""
    params = EngineParams(ema_periods=(5, 10, 20, 50), rsi_period=5, atr_period=5)
    rng, rows, closes = random.Random(1), [], {}
    for name, (n, gaps) in GAPS.items():
        price, closes[name] = 100.0, []
        for i in range(n):
            price *= math.exp(rng.gauss(0, 0.01))
            close = math.nan if i in gaps else price
            closes[name].append((price * 1.01, price * 0.99, close))
            rows.append((name, "1h", i, dt.datetime(2024, 1, 1), price, price * 1.01, price * 0.99, None if i in gaps else price, 1.0))
    rng.shuffle(rows)
    got = ind.recursions(spark.createDataFrame(rows, SCHEMA), params, block_bars=64).toPandas().sort_values("pos")
    assert len(got) == len(rows)
    for name, known in closes.items():
        own, (high, low, close) = got[got["symbol"] == name], np.array(known).T
        before = np.concatenate(([np.nan], close[:-1]))
        spread = np.fmax(high - low, np.fmax(abs(high - before), abs(low - before)))
        move = close - before
        gain, loss = (folded(np.where(np.isnan(move), np.nan, np.maximum(sign * move, 0)), 5, 1 / 5) for sign in (1, -1))
        expected = {"true_range": spread, "atr": folded(spread, 5, 1 / 5), "rsi": ind.strength(gain, loss), **{f"ema_{n}": folded(close, n, 2 / (n + 1)) for n in params.ema_periods}}
        for column, values in expected.items():
            np.testing.assert_allclose(own[column].astype(float), values, rtol=1e-9, err_msg=f"{name} {column}")


@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_ranks_in_blocks(spark, block):
    """The trailing rank of every bar, with ties, unknown values and blocks shorter than a series, is what pandas gives."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(230) < 0.1, np.nan, rng.integers(1, 12, 230).astype(float))
    frame = pd.DataFrame({"symbol": "S", "interval": "1d", "pos": np.arange(230), "atr": x, "close": 2.0, "extra": "e"})
    bars = spark.createDataFrame(frame).withColumn("atr", F.nanvl("atr", F.lit(None)))
    got = ind.atr_percentile(bars, FAST, block).orderBy("pos").collect()
    half = pd.Series(x / 2)
    expected = half.rolling(30, min_periods=10).apply(lambda w: pd.Series(w).rank(pct=True).iloc[-1], raw=False)
    assert len(got) == 230 and got[0]["extra"] == "e"
    for r, y, v in zip(got, expected, half, strict=True):
        assert (r["atr_percentile"] is None and (y != y or v != v)) or abs(r["atr_percentile"] - y) < 1e-12
    assert ind.atr_percentile(bars.limit(0), FAST).count() == 0


def test_intervals_of_a_symbol_stay_apart(spark):
    """Hourly, daily, monthly and minute series of one symbol give what each gives alone."""
    start, rows = dt.datetime(2024, 1, 1), []
    for interval, n, step in (("1h", 24 * 20, dt.timedelta(hours=1)), ("1d", 120, dt.timedelta(days=1)), ("1mo", 30, dt.timedelta(days=30)), ("1m", 90, dt.timedelta(minutes=1)), ("30m", 48 * 3, dt.timedelta(minutes=30))):
        closes = [100 + 10 * math.sin(i / 5) + i / 50 for i in range(n)]
        rows += [("A", interval, i, start + i * step, c, c + 1, c - 1, c, 10.0) for i, c in enumerate(closes)]
    told = lambda own: {(r["interval"], r["pos"]): r["htf"] for r in rs.closed_period(frame(spark, own), rs.higher_timeframe(frame(spark, own), FAST), FAST).collect()}
    together = told(rows)
    assert len(together) == len(rows)
    for interval in ("1h", "1d", "1mo", "1m", "30m"):
        alone = told([r for r in rows if r[1] == interval])
        assert alone == {k: v for k, v in together.items() if k[0] == interval}
    last = {i: max((k for k in together if k[0] == i), key=lambda k: k[1]) for i in ("1h", "1d", "1mo", "1m", "30m")}
    assert together[last["1h"]]["interval"] == "1D" and together[last["1d"]]["interval"] == "1W"
    assert all(together[last[i]] is None for i in ("1mo", "1m", "30m"))  # no rule, no rule, three days: fewer than two sides of a swing and one
    day = rs.resample(frame(spark, rows), "1D").filter("interval = '1h' AND pos = 3").first()
    assert day["volume"] == 240.0 and day["rule"] == "1D"


def test_few_periods_give_no_higher_timeframe(spark):
    hours = lambda n: [("A", "1h", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0 + i % 7, 2.0 + i % 7, 0.5, 1.0 + i % 7, 1.0) for i in range(n)]
    assert rs.higher_timeframe(frame(spark, hours(24 * 5)), FAST).count() == 0
    assert rs.higher_timeframe(frame(spark, hours(24 * 5 + 1)), FAST).count() == 6
    priceless = [(*r[:4], None, *r[5:]) if 24 <= i < 48 else r for i, r in enumerate(hours(24 * 7))]
    assert rs.higher_timeframe(frame(spark, priceless), FAST).count() == 6  # the day without an open is no candle


def test_no_look_ahead_in_the_source():
    for path in (Path(ind.__file__).parent).glob("*.py"):
        text = path.read_text()
        assert "F.lead(" not in text and "unboundedFollowing" not in text, path


def test_resample_weeks_and_months(spark):
    rows = from_closes([10, 20, 30, 40, 50])
    for i, r in enumerate(rows):
        r[3] = dt.datetime(2021, 1, 4) + dt.timedelta(days=i)
    week = rs.resample(frame(spark, rows), "1W").collect()
    assert [(r["open"], r["close"], r["ts"], r["period_end"]) for r in week] == [(10.0, 50.0, dt.datetime(2021, 1, 3), dt.datetime(2021, 1, 10))]
    rows[4][3] = dt.datetime(2021, 1, 31)
    month = rs.resample(frame(spark, rows), "1ME").orderBy("ts").collect()
    assert [(r["ts"], r["period_end"]) for r in month] == [(dt.datetime(2020, 12, 31), dt.datetime(2021, 1, 31)), (dt.datetime(2021, 1, 31), dt.datetime(2021, 2, 28))]


def test_setups_fire_and_miss(spark):
    """A shallow uptrend reaches its own rule; nothing is set up without an ATR."""
    points = [100.0]
    for _ in range(8):
        points += [points[-1] * 1.05, points[-1] * 1.05 * 0.985]
    bars = described(frame(spark, from_closes(zigzag(points, 4))), FAST)
    names = {s["name"] for r in bars.select("setups").collect() for s in r["setups"]}
    assert "TREND_CONTINUATION_LONG" in names
    early = bars.filter("atr IS NULL").select("setups", "near_miss_setups").collect()
    assert early and all(not r["setups"] and not r["near_miss_setups"] for r in early)


# ------------------------------------------------------------------ gate


def found(spark, rows):
    bars = frame(spark, rows)
    every = validate.all_issues(bars)
    return {(r["code"], r["severity"]) for r in every.collect()}, validate.verdicts(bars, every).first()["verdict"]


def swap(rows, i, j):
    rows[i][3], rows[j][3] = rows[j][3], rows[i][3]


def put(rows, i, c, value):
    rows[i][c] = value


def renumber(rows):
    for i, r in enumerate(rows):
        r[2] = i


DEFECTS = {
    "null close": (lambda r: put(r, 5, 7, None), ("NULL_VALUE", "ERROR"), "FAIL"),
    "null volume": (lambda r: put(r, 7, 8, None), ("NULL_VALUE", "WARNING"), "PASS_WITH_WARNINGS"),
    "swapped": (lambda r: swap(r, 10, 11), ("OUT_OF_ORDER", "ERROR"), "FAIL"),
    "same time": (lambda r: put(r, 20, 3, r[19][3]), ("DUPLICATE_TIMESTAMP", "ERROR"), "FAIL"),
    "same row": (lambda r: (r.append(list(r[30])), renumber(r)), ("DUPLICATE_ROW", "ERROR"), "FAIL"),
    "high below low": (lambda r: put(r, 9, 5, r[9][6] - 1), ("HIGH_BELOW_LOW", "ERROR"), "FAIL"),
    "high below open": (lambda r: put(r, 9, 5, r[9][4] - 1), ("HIGH_BELOW_OPEN", "ERROR"), "FAIL"),
    "low above close": (lambda r: put(r, 9, 6, r[9][7] + 1), ("LOW_ABOVE_CLOSE", "ERROR"), "FAIL"),
    "no price": (lambda r: [put(r, 9, c, 0.0) for c in (4, 5, 6, 7)], ("NON_POSITIVE_PRICE", "ERROR"), "FAIL"),
    "negative volume": (lambda r: put(r, 9, 8, -1.0), ("NEGATIVE_VOLUME", "ERROR"), "FAIL"),
    "idle": (lambda r: [put(r, i, 8, 0.0) for i in range(10, 26)], ("ZERO_VOLUME_RUN", "WARNING"), "PASS_WITH_WARNINGS"),
    "hole": (lambda r: (r.__delitem__(slice(40, 48)), renumber(r)), ("MISSING_CANDLES", "WARNING"), "PASS_WITH_WARNINGS"),
    "holiday": (lambda r: (r.__delitem__(45), renumber(r)), ("HOLIDAY_BREAK", "INFO"), "PASS"),
    "wrong interval": (lambda r: [put(r, i, 1, "1h") for i in range(len(r))], ("INTERVAL_MISMATCH", "WARNING"), "PASS_WITH_WARNINGS"),
    "split": (lambda r: [put(r, i, c, r[i][c] / 2) for i in range(60, 120) for c in (4, 5, 6, 7)], ("ABNORMAL_GAP", "WARNING"), "PASS_WITH_WARNINGS"),
    "wide bar": (lambda r: put(r, 50, 5, r[50][7] * 1.6), ("ABNORMAL_BAR_RANGE", "WARNING"), "PASS_WITH_WARNINGS"),
}


def test_clean_series_pass(spark):
    codes, verdict = found(spark, clean_daily())
    assert verdict == "PASS" and not {c for c in codes if c[1] != "INFO"}


@pytest.mark.parametrize("name", DEFECTS)
def test_one_defect(spark, name):
    rows = clean_daily()
    break_, expected, verdict = DEFECTS[name]
    break_(rows)
    codes, got = found(spark, rows)
    assert expected in codes and got == verdict


def test_schema_findings(spark):
    bars = frame(spark, clean_daily(5))
    assert validate.column_findings(bars.drop("volume").withColumn("extra", F.lit(1)).columns) == [("MISSING_COLUMN", "ERROR", "volume"), ("EXTRA_COLUMN", "INFO", "extra")]
    assert validate.type_findings(bars.withColumn("close", F.lit("x"))) == [("NON_NUMERIC_COLUMN", "ERROR", "close")]


def test_unclosed_tail_only(spark):
    rows = clean_daily(10)
    rows[4][7] = rows[9][7] = None
    assert [r["pos"] for r in validate.drop_unclosed_tail(frame(spark, rows)).orderBy("pos").collect()] == list(range(9))


def test_empty_series(spark):
    nothing = frame(spark, [])
    assert validate.all_issues(nothing).count() == 0
    assert contexts(nothing, params=FAST).count() == 0


# --------------------------------------------------------------- sampling


def test_sample_properties(spark):
    states = [("UPTREND", "LOW"), ("DOWNTREND", "HIGH"), ("RANGE", "NORMAL"), ("CONTRACTION", "LOW"), ("EXPANSION", "HIGH")]
    rows = [(s, "1d", i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *states[(i // 7 + k) % 5]) for k, s in enumerate(("A", "B")) for i in range(2500)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, pos int, ts timestamp, trend string, vol_regime string")
    spec = sampler.SampleSpec(target_count=40, cutoff="2025-01-01", min_separation=40)
    picked = sampler.choose(sampler.candidates(bars, spec), spec)
    got = picked.orderBy("pick").collect()
    assert got == sampler.choose(sampler.candidates(bars, spec), spec).orderBy("pick").collect()
    assert len(got) == 40 and all(250 <= r["pos"] < 1827 for r in got)
    for s in "AB":
        at = sorted(r["pos"] for r in got if r["symbol"] == s)
        assert all(b - a >= 40 for a, b in zip(at, at[1:], strict=False))
    counts = {r["value"]: r["n"] for r in sampler.describe(picked).filter("dimension = 'stratum'").collect()}
    assert len(counts) == 5 and max(counts.values()) - min(counts.values()) <= 2


def greedy(rows, spec):
    """The choice by plain lists: (stratum, source, pos) in order."""
    pool = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["pos"])):
        pool.setdefault(r["stratum"], {}).setdefault(r["source"], []).append(r["pos"])
    order = sorted(pool, key=lambda k: (sum(map(len, pool[k].values())), k))
    turn, taken, out, progress = dict.fromkeys(order, 0), {}, [], True
    while progress and len(out) < spec.target_count:
        progress = False
        for stratum in order:
            sources = sorted(pool[stratum])
            for k in range(len(sources)):
                source = sources[(turn[stratum] + k) % len(sources)]
                near = taken.setdefault(source, set())
                free = next((p for p in pool[stratum][source] if p not in near), None)
                if free is not None and len(out) < spec.target_count:
                    out.append((stratum, source, free))
                    near.update(range(free - spec.separation + 1, free + spec.separation))
                    turn[stratum], progress = (turn[stratum] + k) % len(sources) + 1, True
                    break
    return out


@pytest.mark.parametrize(("series", "bars", "separation", "target", "batch"), [(1, 6000, 12, 2000, None), (5, 40, 9, 500, (2, 3))])
def test_sample_uses_every_candidate(spark, monkeypatch, series, bars, separation, target, batch):
    """A long series, whose later candidates are needed as well; and small batches of sources and rows."""
    if batch:
        monkeypatch.setattr(sampler, "BATCH_SOURCES", batch[0])
        monkeypatch.setattr(sampler, "BATCH_ROWS", batch[1])
    rng = random.Random(5)
    rows = [(f"S{s}", "1m", i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), rng.choice(("UPTREND", "RANGE")) if series > 1 else "RANGE", "LOW") for s in range(series) for i in range(bars)]
    frame_ = spark.createDataFrame(rows, "symbol string, interval string, pos int, ts timestamp, trend string, vol_regime string")
    spec = sampler.SampleSpec(target_count=target, cutoff="2025-01-01", min_bar_index=0, min_separation=separation)
    found = sampler.candidates(frame_, spec)
    got = [(r["stratum"], r["source"], r["pos"]) for r in sampler.choose(found, spec).orderBy("pick").collect()]
    assert got == greedy(found.collect(), spec)


def test_strided_bars(spark):
    got = strided(frame(spark, clean_daily(120)), 5, warm_up=20).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [20, 40, 60, 80, 100]


# --------------------------------------------------------------- whole tables


def test_positions_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 20)
    rng = random.Random(3)
    rows = [(rng.choice("abc"), k) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, pos int")
    ranges = ranks.numbered(df, 300, ("symbol", "pos"))
    assert [(r["symbol"], r["pos"]) for r in ranges.orderBy("__at").collect()] == sorted(rows)
    picked = summary.strided(df, 7, ("symbol", "pos"))
    assert sorted(map(tuple, picked.collect())) == [sorted(rows)[i * 300 // 7] for i in range(7)]
    # The one window without partitions is over the counts of the ranges.
    windows = [line for line in picked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert any("row_number" in line and "[__range" in line for line in windows) and not any("row_number" in line and "[__range" not in line for line in windows)


def test_ranks_without_arrays(spark):
    rng = random.Random(4)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, rng.randrange(50), rng.randrange(10**6)))) for _ in range(3000)] + [("none", None), ("one", 5)]
    got = views.length_stats(spark.createDataFrame(rows, "m string, t long"), "t", "m")
    expected = set()
    for m in {m for m, _ in rows}:
        v = sorted(t for k, t in rows if k == m and t is not None)
        expected.add((m, len(v), *((v[len(v) // 2], v[int(len(v) * 0.95)], v[-1]) if v else (None,) * 3)))
    assert set(map(tuple, got.collect())) == expected
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
