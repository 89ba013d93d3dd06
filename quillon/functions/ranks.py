"""Positions and ranks over whole tables, numbered in ranges side by side.

No task numbers or holds all rows: bounds cut the order into ranges, each is numbered by itself, and
the counts of the ranges before it are added. Bounds only split the work; results don't depend on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, if no more than RANGES are needed; keys that bounds are taken from for each range; ranges of a group's values.
RANGE_ROWS, RANGES, SAMPLED, VALUE_RANGES = 50_000, 256, 16, 64


def numbered(rows: DataFrame, n: int, order: tuple[str, ...], out: str = "__at") -> DataFrame:
    """Adds the position, from 0, of each of the n rows in an order by columns."""
    ranges = min(RANGES, 1 + n // RANGE_ROWS)
    keys = rows.select(*order).orderBy(F.xxhash64(*order)).limit(ranges * SAMPLED).orderBy(*order).collect() if ranges > 1 else []
    bounds = keys[SAMPLED::SAMPLED]
    types = [rows.schema[c].dataType for c in order]
    literal = lambda k: F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, k, types, strict=True)])
    own = F.struct(*order)
    at = F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= own)) if bounds else F.lit(0)
    rows = rows.withColumn("__range", at)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # At most RANGES rows.
    starts = rows.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(within)).join(F.broadcast(starts), "__range")
    return rows.withColumn(out, F.col("__base") + F.col("__n") - 1).drop("__range", "__base", "__n")


def at_ranks(rows: DataFrame, value: Column, by: tuple[str, ...], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, and for each name the non-null value at a rank, from 0, of each group's sorted values; a rank is told from their number.

    Groups are few, their values any number.
    """
    counts = rows.select(F.struct(*by).alias("__g"), value.alias("__v")).filter(F.col("__v").isNotNull()).groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c"))
    shares = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    groups = counts.groupBy("__g").agg(F.sum("__c").alias("__total"), F.percentile_approx("__v", shares, 1000).alias("__bounds"))
    counts = counts.join(F.broadcast(groups), "__g").withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= F.col("__v")))).drop("__bounds")
    before = Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # At most VALUE_RANGES rows a group.
    starts = counts.groupBy("__g", "__range").agg(F.sum("__c").alias("__rows")).select("__g", "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__g", "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__sum", F.sum("__c").over(within)).join(F.broadcast(starts), ["__g", "__range"]).withColumn("__upto", F.col("__base") + F.col("__sum"))
    here = lambda k: (k >= F.col("__upto") - F.col("__c")) & (k < F.col("__upto"))
    found = upto.groupBy("__g").agg(*[F.max(F.when(here(rank(F.col("__total"))), F.col("__v"))).alias(name) for name, rank in ranks.items()])
    return found.select("__g.*", *ranks)
