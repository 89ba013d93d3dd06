"""Support and resistance: confirmed swing prices in clusters around each bar.

For a few bars the clusters are folded from an array of the swings known there (``levels``). For every
bar of a series that array would be quadratic, so ``series_levels`` walks the swings of a series once
in order of price, for all bars together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalar import SERIES, so_far
from ..params import EngineParams

_CLUSTER = "struct<price:double,touches:int,first_index:int,last_index:int>"
_NEAR = ArrayType(StructType([StructField("price", DoubleType()), StructField("touches", IntegerType()), StructField("first_index", IntegerType()), StructField("last_index", IntegerType())]))


def _swings_at(params: EngineParams) -> Column:
    """The swings confirmed at a bar, none to two."""
    k = params.swing_lookback
    one = lambda kind, price, label: F.when(F.col(price).isNotNull(), F.struct((F.col("pos") - k).cast("int").alias("index"), F.lit(kind).alias("kind"), F.col(price).alias("price"), F.col(label).alias("label"), F.col("pos").cast("int").alias("confirmed_index"), F.col("swing_ts").alias("timestamp")))
    return F.array_compact(F.array(one("HIGH", "swing_high", "high_label"), one("LOW", "swing_low", "low_label")))


def swing_rows(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """A row for each swing: series and s. bars: with swing columns."""
    return bars.filter(F.col("swing_high").isNotNull() | F.col("swing_low").isNotNull()).select(*SERIES, F.explode(_swings_at(params)).alias("s"))


def recent_swings(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds known: the latest swings confirmed so far, in print order, at least max_swings_in_context where there are as many.

    bars: with swing columns. A frame over the running number of swings, so no array grows with a series.
    """
    here = _swings_at(params)
    latest = Window.partitionBy(*SERIES).orderBy("__n").rangeBetween(1 - params.max_swings_in_context, 0)
    out = bars.withColumn("__n", F.sum(F.size(here)).over(so_far()))
    return out.withColumn("known", F.flatten(F.collect_list(F.when(F.size(here) > 0, here)).over(latest))).drop("__n")


def levels(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds levels to bars with known (all swings confirmed there), close and atr: the nearest clusters on each side, by price.

    Prices are taken in ascending order; one joins the cluster before it if it is within a fraction
    of the ATR of the cluster's mean. Without a positive ATR there are no levels.
    """
    near = F.col("atr") * params.level_cluster_atr
    empty = F.array().cast(f"array<{_CLUSTER}>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last"), empty.alias("done"))

    def closed(a):
        made = F.struct((a.sum / F.greatest(a.n, F.lit(1))).alias("price"), a.n.alias("touches"), a["first"].alias("first_index"), a["last"].alias("last_index"))
        return F.when(a.n >= params.level_min_touches, F.concat(a.done, F.array(made))).otherwise(a.done)

    def step(a, x):
        joins = (a.n > 0) & (F.abs(x.price - a.sum / F.greatest(a.n, F.lit(1))) <= near)
        pick = lambda yes, no: F.when(joins, yes).otherwise(no)
        return F.struct(
            pick(a.sum + x.price, x.price).alias("sum"),
            pick(a.n + 1, F.lit(1)).alias("n"),
            pick(F.least(a["first"], x["index"]), x["index"]).alias("first"),
            pick(F.greatest(a["last"], x["index"]), x["index"]).alias("last"),
            pick(a.done, closed(a)).alias("done"),
        )

    ordered = F.sort_array(F.transform("known", lambda s: F.struct(s.price.alias("price"), s["index"].alias("index"))))
    clusters = F.when(F.col("atr") > 0, F.aggregate(ordered, start, step, closed)).otherwise(empty)
    most = params.max_levels_per_side
    out = bars.withColumn("__c", clusters)
    below = F.slice(F.sort_array(F.filter("__c", lambda c: c.price <= F.col("close")), asc=False), 1, most)
    above = F.slice(F.sort_array(F.filter("__c", lambda c: c.price > F.col("close"))), 1, most)
    return out.withColumn("levels", F.transform(F.concat(F.reverse(below), above), _described)).drop("__c")


def _described(c: Column) -> Column:
    return F.struct(
        c.price.alias("price"),
        F.when(c.price > F.col("close"), "RESISTANCE").otherwise("SUPPORT").alias("side"),
        c.touches.alias("touches"),
        ((c.price - F.col("close")) / F.col("atr")).alias("distance_atr"),
        c.first_index.alias("first_index"),
        c.last_index.alias("last_index"),
    )


class _Nearest:
    """The clusters kept on each side of each bar, ``most`` at most, as clusters close in ascending order of price."""

    def __init__(self, close: np.ndarray, most: int):
        self.close, self.most = close, most
        self.kept = {side: (np.zeros((len(close), most, 4)), np.zeros(len(close), int)) for side in ("below", "above")}

    def add(self, bars: np.ndarray, clusters: np.ndarray) -> None:
        under = clusters[:, 0] <= self.close[bars]
        values, count = self.kept["below"]
        full = under & (count[bars] == self.most)
        values[bars[full], :-1] = values[bars[full], 1:]
        count[bars[full]] -= 1
        self._append("below", bars[under], clusters[under])
        room = ~under & (self.kept["above"][1][bars] < self.most)
        self._append("above", bars[room], clusters[room])

    def _append(self, side: str, bars: np.ndarray, clusters: np.ndarray) -> None:
        values, count = self.kept[side]
        values[bars, count[bars]] = clusters
        count[bars] += 1

    def column(self, rows: np.ndarray, length: int) -> pa.Array:
        """A list of structs for each of ``length`` bars; those not in ``rows`` have none."""
        sizes = np.zeros(length, int)
        sizes[rows] = sum(count for _, count in self.kept.values())
        used = np.concatenate([np.arange(self.most) < count[:, None] for _, count in self.kept.values()], axis=1)
        flat = np.concatenate([values for values, _ in self.kept.values()], axis=1)[used]
        names = [f.name for f in _NEAR.elementType.fields]
        columns = [pa.array(flat[:, 0]), *(pa.array(flat[:, i].astype("int32")) for i in (1, 2, 3))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32()), pa.StructArray.from_arrays(columns, names))


def _cluster_series(pos: np.ndarray, close: np.ndarray, atr: np.ndarray, swings: np.ndarray, params: EngineParams) -> pa.Array:
    """The nearest clusters of each bar. pos ascending; swings: rows of price, index, confirmed_index."""
    rows = np.flatnonzero((atr > 0) & ~np.isnan(close))
    pos, near = pos[rows], atr[rows] * params.level_cluster_atr
    swings = swings[np.lexsort((swings[:, 1], swings[:, 0]))]
    total, n, first, last = (np.zeros(len(rows)) for _ in range(4))
    nearest = _Nearest(close[rows], params.max_levels_per_side)

    def close_clusters(bars: np.ndarray) -> None:
        bars = bars[n[bars] >= params.level_min_touches]
        nearest.add(bars, np.column_stack((total[bars] / n[bars], n[bars], first[bars], last[bars])))

    for (price, index, _), start in zip(swings, np.searchsorted(pos, swings[:, 2]), strict=True):
        t, k = total[start:], n[start:]
        joins = (k > 0) & (np.abs(price - t / np.maximum(k, 1)) <= near[start:])
        opens = np.flatnonzero(~joins) + start
        close_clusters(opens)
        t += price
        k += 1
        np.minimum(first[start:], index, out=first[start:])
        np.maximum(last[start:], index, out=last[start:])
        total[opens], n[opens], first[opens], last[opens] = price, 1, index, index
    close_clusters(np.arange(len(rows)))
    return nearest.column(rows, len(close))


def series_levels(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds levels, as ``levels`` does, to every bar of a series with swing columns, close and atr.

    Work is bars x swings of a series in vector steps, memory a few numbers a bar. A series without
    swings, or a bar without a close or a positive ATR, has no levels.
    """
    schema = StructType([*bars.schema.fields, StructField("__near", _NEAR)])

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        number = lambda c: own[c].cast("double").to_numpy()
        pos = number("pos")
        found = [np.column_stack((price[at], pos[at] - params.swing_lookback, pos[at])) for price in (number("swing_high"), number("swing_low")) for at in [~np.isnan(price)]]
        return own.append_column("__near", _cluster_series(pos, number("close"), number("atr"), np.concatenate(found), params))

    out = bars.groupBy(*SERIES).applyInArrow(run, schema)
    return out.withColumn("levels", F.transform("__near", _described)).drop("__near")
