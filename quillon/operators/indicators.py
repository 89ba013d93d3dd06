"""Causal indicators: every value at a bar depends on that bar and earlier ones only.

Row-local and windowed indicators are built-in expressions over one partitioning by series. Seeded
recursions (moving averages, RSI, ATR) have no window form. A step of one, y = a x + (1 - a) y', is
affine in y', and so is a block of steps: a series is cut into blocks of bars, each block sums itself
up as slope and offset (and where the recursion starts in it, if it does), a scan over these few
numbers gives the state before each block, and all blocks then fill in their bars at the same time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalar import SERIES, full, ratio, series_window, trailing
from ..params import BARS_PER_YEAR, DEFAULT_BARS_PER_YEAR, EngineParams

#: Bars of a series that one task steps through.
BLOCK_BARS = 1 << 16
_BLOCK = (*SERIES, "__block")


def resumed(x: np.ndarray, n: int, alpha: float, start: int = 0, state: float | None = None) -> tuple[np.ndarray, float | None]:
    """The recursion at x[start:], and the state after it: None before the seed, NaN once a value was missing.

    state: what the recursion had before x[start]. Without one it starts from the mean of the first n
    consecutive finite values, of which up to n - 1 may lie before ``start``. A missing value after
    the seed makes all that follow missing.
    """
    out = np.full(len(x) - start, np.nan)
    at = 0
    if state is None:
        known = np.concatenate((np.zeros(n), np.isfinite(x).cumsum()))
        seeds = np.flatnonzero((known[n:] - known[: len(x)] == n)[start:])
        if not len(seeds):
            return out, None
        at = int(seeds[0])
        state = x[start + at - n + 1 : start + at + 1].mean()
        out[at] = state
        at += 1
    values = np.concatenate(([state], x[start + at :]))
    broken = np.flatnonzero(~np.isfinite(values))
    end = int(broken[0]) if len(broken) else len(values)
    out[at : at + max(0, end - 1)] = pd.Series(values[:end]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
    return out, float(out[-1]) if len(out) else state


def seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    return resumed(x, n, alpha)[0]


def strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, np.where(gain > 0, 100.0, np.nan), 100 - 100 / (1 + gain / loss))


def _moves(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    move = np.diff(close, prepend=np.nan)
    return np.where(np.isnan(move), np.nan, np.maximum(move, 0)), np.where(np.isnan(move), np.nan, np.maximum(-move, 0))


def relative_strength(close: np.ndarray, n: int) -> np.ndarray:
    return strength(*(seeded(x, n, 1 / n) for x in _moves(close)))


_PREVIOUS = "__previous"


def _ranged(bars: DataFrame, previous: Column) -> DataFrame:
    return bars.withColumn(_PREVIOUS, previous).withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(_PREVIOUS)), F.abs(F.col("low") - F.col(_PREVIOUS)))).drop(_PREVIOUS)


def true_range(bars: DataFrame) -> DataFrame:
    """Adds true_range; the first bar has its own range."""
    return _ranged(bars, F.lag("close").over(series_window()))


class _Block:
    """The inputs of all recursions over one block, its halo first, in order of bars."""

    def __init__(self, bars: pa.Table, params: EngineParams):
        self.bars = bars = bars.sort_by("pos")
        self.start = int(np.count_nonzero(bars["__halo"].to_numpy()))
        number = lambda c: bars[c].cast("double").to_numpy()
        close = number("close")
        gain, loss = _moves(close)
        n, m = params.atr_period, params.rsi_period
        self.steps = [(number("true_range"), n, 1 / n), (gain, m, 1 / m), (loss, m, 1 / m), *((close, k, 2 / (k + 1)) for k in params.ema_periods)]

    def summary(self) -> Iterator[tuple[float, float, float | None]]:
        """(slope, offset, state after the block where it starts in it) for each recursion."""
        for x, n, alpha in self.steps:
            own = x[self.start :]
            offset = resumed(own, n, alpha, 0, 0.0)[1]
            yield (1 - alpha) ** len(own), offset, resumed(x, n, alpha, self.start)[1]

    def values(self, states: list[float | None]) -> list[np.ndarray]:
        """atr, rsi and the moving averages of the block's own bars."""
        atr, gain, loss, *averages = (resumed(x, n, alpha, self.start, state)[0] for (x, n, alpha), state in zip(self.steps, states, strict=True))
        return [atr, strength(gain, loss), *averages]


def _with_halo(bars: DataFrame, block: int, halo: int) -> DataFrame:
    """Every bar in its block, and the last ``halo`` bars of a block once more before the next one."""
    here = F.floor(F.col("pos") / block)
    both = F.when(F.col("pos") % block >= block - halo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return bars.withColumn("__halo", F.explode(both)).withColumn("__block", here + F.col("__halo").cast("long"))


def recursions(bars: DataFrame, params: EngineParams = EngineParams(), block_bars: int = BLOCK_BARS) -> DataFrame:
    """Adds true_range (where bars lack it), atr, rsi and ema_<n>. pos counts the bars of a series from 0, without gaps.

    A task holds one block. Both passes read the same exchange by block, and only full blocks, which
    others may follow, are summed up: a series of one block costs one step.
    """
    periods = (params.atr_period, params.rsi_period, params.rsi_period, *params.ema_periods)
    halo = max(periods) + 1
    block_bars = max(block_bars, halo)
    names = ["atr", "rsi", *(f"ema_{n}" for n in params.ema_periods)]
    blocks = _with_halo(bars, block_bars, halo)
    if "true_range" not in bars.columns:
        blocks = _ranged(blocks, F.lag("close").over(Window.partitionBy(*_BLOCK).orderBy("pos")))
    kept = [f for f in blocks.schema.fields if f.name not in ("__halo", "__block")]
    key = [blocks.schema[c] for c in _BLOCK]
    lists = lambda *columns: [StructField(c, ArrayType(DoubleType())) for c in columns]

    def table(own: pa.Table, rows: list[tuple], columns: tuple[str, ...]) -> pa.Table:
        """rows of a block number and a list for each further column, under the key of own."""
        types = [own.schema.field(c).type for c in _BLOCK] + [pa.list_(pa.float64())] * (len(columns))
        series = tuple(own[c][0].as_py() for c in SERIES)
        return pa.table([pa.array(values, t) for values, t in zip(zip(*(series + r for r in rows), strict=True) if rows else [[]] * len(types), types, strict=True)], names=[*_BLOCK, *columns])

    def summarise(own: pa.Table) -> pa.Table:
        pos = own["pos"].to_numpy()[~own["__halo"].to_numpy()]
        followed = len(pos) and (pos.max() + 1) % block_bars == 0
        rows = [(own["__block"][0].as_py(), *map(list, zip(*_Block(own, params).summary(), strict=True)))] if followed else []
        return table(own, rows, ("slope", "offset", "started"))

    def scan(own: pa.Table) -> pa.Table:
        state, rows = [None] * len(periods), []
        for r in own.sort_by("__block").to_pylist():
            state = [s if y is None else a * y + b for a, b, s, y in zip(r["slope"], r["offset"], r["started"], state, strict=True)]
            rows.append((r["__block"] + 1, state))
        return table(own, rows, ("states",))

    def fill(own: pa.Table, before: pa.Table) -> pa.Table:
        block = _Block(own, params)
        state = before["states"][0].as_py() if before.num_rows else [None] * len(periods)
        out = block.bars.slice(block.start).select([f.name for f in kept])
        for name, values in zip(names, block.values(state), strict=True):
            out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return out

    sums = blocks.groupBy(*_BLOCK).applyInArrow(summarise, StructType([*key, *lists("slope", "offset", "started")]))
    before = sums.groupBy(*SERIES).applyInArrow(scan, StructType([*key, *lists("states")]))
    schema = StructType([*kept, *(StructField(name, DoubleType()) for name in names)])
    return blocks.groupBy(*_BLOCK).cogroup(before.groupBy(*_BLOCK)).applyInArrow(fill, schema)


def windowed(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds return_<n>, log_return, realized_vol, volume_ratio, volume_zscore, has_volume, efficiency."""
    w = series_window()
    per_year = F.lit(DEFAULT_BARS_PER_YEAR)
    for interval, n in BARS_PER_YEAR.items():
        per_year = F.when(F.col("interval") == interval, F.lit(n)).otherwise(per_year)
    out = bars
    for n in params.return_periods:
        out = out.withColumn(f"return_{n}", ratio(F.col("close"), F.lag("close", n).over(w)) - 1)
    growth = ratio(F.col("close"), F.lag("close").over(w))
    out = out.withColumn("log_return", F.when(growth > 0, F.ln(growth))).withColumn("move", F.abs(F.col("close") - F.lag("close").over(w)))
    v, m, k = params.realized_vol_window, params.volume_sma_window, params.efficiency_window
    mean, spread = F.avg("volume").over(trailing(m)), F.stddev_samp("volume").over(trailing(m))
    path = full(F.col("move"), k, F.sum("move").over(trailing(k)))
    return out.select(
        *[c for c in out.columns if c != "move"],
        full(F.col("log_return"), v, F.stddev_samp("log_return").over(trailing(v)) * F.sqrt(per_year)).alias("realized_vol"),
        full(F.col("volume"), m, ratio(F.col("volume"), mean)).alias("volume_ratio"),
        full(F.col("volume"), m, ratio(F.col("volume") - mean, spread)).alias("volume_zscore"),
        (F.coalesce(F.max("volume").over(Window.partitionBy(*SERIES)), F.lit(0.0)) > 0).alias("has_volume"),
        ratio(F.abs(F.col("close") - F.lag("close", k).over(w)), path).alias("efficiency"),
    )


def trailing_ranks(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """The average rank of each value among the known ones of its trailing window, as a share; NaN where it is missing or fewer than ``least`` are known.

    The window is kept sorted: a value goes in and one goes out by bisection, so a wide window costs little more than a narrow one.
    """
    out, held, values = np.full(len(x), np.nan), [], x.tolist()
    for i, v in enumerate(values):
        if i >= window and (gone := values[i - window]) == gone:
            del held[bisect_left(held, gone)]
        if v == v:
            insort(held, v)
            if len(held) >= least:
                out[i] = (bisect_left(held, v) + bisect_right(held, v) + 1) / 2 / len(held)
    return out


def atr_percentile(bars: DataFrame, params: EngineParams = EngineParams(), block_bars: int = BLOCK_BARS) -> DataFrame:
    """Adds atr_pct and its average-rank percentile among the trailing window; a task holds a block of a series and the window before it."""
    window = params.atr_percentile_window
    bars = bars.withColumn("atr_pct", ratio(F.col("atr"), F.col("close")))
    names = bars.columns

    def rank(own: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        ranks = trailing_ranks(own["atr_pct"].to_numpy(), window, params.atr_percentile_min_periods)
        out = own.append_column("atr_percentile", pa.array(ranks, pa.float64(), from_pandas=True))
        return out.slice(int(np.count_nonzero(own["__halo"].to_numpy()))).select([*names, "atr_percentile"])

    blocks = _with_halo(bars, max(block_bars, window), window)
    return blocks.groupBy(*_BLOCK).applyInArrow(rank, StructType([*bars.schema.fields, StructField("atr_percentile", DoubleType())]))


def classify_volatility(p) -> Column:
    return F.when(p.isNull(), "UNKNOWN").when(p < 0.25, "LOW").when(p < 0.75, "NORMAL").when(p < 0.90, "HIGH").otherwise("EXTREME")


def classify_trend_regime(er, params: EngineParams = EngineParams()) -> Column:
    return F.when(er.isNull(), "UNKNOWN").when(er >= params.trend_er_min, "TRENDING").when(er <= params.range_er_max, "RANGING").otherwise("MIXED")


def indicators(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """All indicators and the two regime labels."""
    out = windowed(atr_percentile(recursions(bars, params), params), params)
    return out.withColumn("vol_regime", classify_volatility(F.col("atr_percentile"))).withColumn("trend_regime", classify_trend_regime(F.col("efficiency"), params))
