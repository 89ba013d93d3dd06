"""Column builders that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ("symbol", "interval")


def series_window():
    """Bars of one series in file order."""
    return Window.partitionBy(*SERIES).orderBy("pos")


def trailing(n: int):
    return series_window().rowsBetween(-(n - 1), 0)


def so_far():
    return series_window().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return series_window().rowsBetween(Window.unboundedPreceding, -1)


def finite(x: Column) -> Column:
    """Null instead of NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def full(x: Column, n: int, value: Column) -> Column:
    """value where the last n bars all have x."""
    return F.when(F.count(x).over(trailing(n)) == n, value)


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in [a, b); negative where b is before a."""
    n = F.abs(F.datediff(b, a))
    first = F.least(a, b)
    rest = F.size(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (k < n % 7) & (F.weekday(F.date_add(first, k)) < 5)))
    days = F.floor(n / 7) * 5 + rest
    return F.when(F.datediff(b, a) < 0, -days).otherwise(days).cast("long")


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The value at the half-even rounded rank q(n - 1) of a sorted array."""
    n = F.size(sorted_values)
    index = F.least(n - 1, F.bround(F.lit(q) * (n - 1), 0).cast("int"))
    return F.when(n > 0, F.get(sorted_values, index))


def close_to(a: Column, b: Column) -> Column:
    """Equal within a relative millionth or an absolute ten-thousandth."""
    return F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-4))
