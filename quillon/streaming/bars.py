"""Candles and recursive indicators of a stream, equal to the batch ones on closed bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECURSIVE = "symbol string, ts timestamp, close double, ema double, n bigint"
_STATE = "n bigint, total double, ema double"


def stream_bars(events: DataFrame, every: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Windowed candles of a stream of symbol, ts, price, event_id; a bar is final when the watermark passes its end."""
    at = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", every).alias("w"))
    return grouped.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, n: int) -> DataFrame:
    """The seeded moving average of closed bars, kept as state for each symbol. bars: symbol, ts, close, in order of time."""
    alpha = 2 / (n + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, ema = state.get if state.exists else (0, 0.0, float("nan"))
        out = []
        for frame in frames:
            for r in frame.sort_values("ts").itertuples():
                seen += 1
                if seen <= n:
                    total += r.close
                    ema = total / n if seen == n else float("nan")
                else:
                    ema += alpha * (r.close - ema)
                out.append((key[0], r.ts, r.close, ema, seen))
        state.update((seen, total, ema))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema", "n"])

    return bars.groupBy("symbol").applyInPandasWithState(step, RECURSIVE, _STATE, "append", GroupStateTimeout.NoTimeout)
