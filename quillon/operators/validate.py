"""The data-quality gate: ten checks that report and never repair.

Checks see bars in file order (pos). All row-level findings of all series come from one pass over
one partitioning; each check is a builder of findings, so a new one is a new entry in CHECKS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import SERIES, business_days, iso8601, series_window, stamp
from ..params import CALENDAR_INTERVALS, INTERVAL_SECONDS, Thresholds

REQUIRED = ("ts", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
SAMPLES = 10
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826

#: The offset at the end of a time's text.
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _found(check: str, code: str, severity: str, mask: Column, field: str | None = None) -> Column:
    return F.when(mask, F.struct(F.lit(check).alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field")))


def missing_values() -> list[Column]:
    return [_found("missing_values", "NULL_VALUE", WARNING if c == "volume" else ERROR, F.col(c).isNull(), c) for c in REQUIRED]


def _has(column: str) -> Column:
    """Whether the row's file has a column."""
    return F.array_contains("columns", "datetime" if column == "ts" else column)


def chronological_order() -> list[Column]:
    return [_found("chronological_order", "OUT_OF_ORDER", ERROR, F.col("ts") < F.lag("ts").over(series_window()))]


def duplicates() -> list[Column]:
    """All but the first of equal times, and of equal rows."""
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*SERIES, *keys).orderBy("pos"))
    return [
        _found("duplicates", "DUPLICATE_TIMESTAMP", ERROR, F.col("ts").isNotNull() & (nth("ts") > 1)),
        _found("duplicates", "DUPLICATE_ROW", ERROR, nth(*REQUIRED) > 1),
    ]


def ohlc_relationships() -> list[Column]:
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    broken = {
        "HIGH_BELOW_LOW": F.col("high") < F.col("low"),
        "HIGH_BELOW_OPEN": F.col("high") < F.col("open"),
        "HIGH_BELOW_CLOSE": F.col("high") < F.col("close"),
        "LOW_ABOVE_OPEN": F.col("low") > F.col("open"),
        "LOW_ABOVE_CLOSE": F.col("low") > F.col("close"),
    }
    return [_found("ohlc_relationships", code, ERROR, whole & bad) for code, bad in broken.items()]


def value_domains() -> list[Column]:
    return [*[_found("value_domains", "NON_POSITIVE_PRICE", ERROR, F.col(c) <= 0, c) for c in PRICES], _found("value_domains", "NEGATIVE_VOLUME", ERROR, F.col("volume") < 0)]


def bar_range(limits: Thresholds) -> list[Column]:
    wide = F.try_divide(F.col("high") - F.col("low"), F.abs(F.col("close"))) > limits.max_bar_range_pct
    return [_found("abnormal_gaps", "ABNORMAL_BAR_RANGE", WARNING, wide)]


#: Row-level checks that need nothing but the bars.
CHECKS: dict[str, Callable[[], list[Column]]] = {f.__name__: f for f in (missing_values, chronological_order, duplicates, ohlc_relationships, value_domains)}


def row_findings(bars: DataFrame, limits: Thresholds = Thresholds(), checks: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each finding at a bar: series, pos, ts, check, code, severity, field."""
    builders = [x for name, f in CHECKS.items() if checks is None or name in checks for x in f()]
    if "columns" in bars.columns:  # a column that a file lacks has one finding, not one a row
        absent = F.transform(F.filter(F.array(*[F.struct(F.lit(c).alias("c"), _has(c).alias("there")) for c in REQUIRED]), lambda x: ~x.there), lambda x: x.c)
        builders = [F.when(~((b["code"] == "NULL_VALUE") & F.array_contains(absent, b["field"])), b) for b in builders]
    if checks is None or "abnormal_gaps" in checks:
        builders += bar_range(limits)
    return bars.select(*SERIES, "pos", "ts", F.array_compact(F.array(*builders)).alias("__f")).select(*SERIES, "pos", "ts", F.explode_outer("__f").alias("f")).filter(F.col("f").isNotNull()).select(*SERIES, "pos", "ts", "f.*")


def issues(findings: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Findings by series and code: the count and the first positions. field: null for the codes without one."""
    keys = [*SERIES, "check", "code", "severity", "field"]
    counted = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    first = findings.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter(F.col("__n") <= samples)
    shown = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "ts"))).alias("samples"))
    same = [counted[k].eqNullSafe(shown[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return counted.join(shown, on, "left").select(*[counted[k] for k in keys], "count", "samples")


def declared_seconds(interval: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, n in INTERVAL_SECONDS.items():
        out = F.when(interval == name, F.lit(n)).otherwise(out)
    return out


def inferred_intervals(bars: DataFrame) -> DataFrame:
    """symbol, interval, inferred: the commonest positive step of the sorted times, the smallest of equals; three times at least."""
    known = bars.filter(F.col("ts").isNotNull())
    step = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy(*SERIES).orderBy("ts")))).alias("step")
    steps = known.select(*SERIES, step).filter(F.col("step") > 0).groupBy(*SERIES, "step").agg(F.count(F.lit(1)).alias("n"))
    best = steps.groupBy(*SERIES).agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("inferred"))
    enough = known.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("times")).filter("times >= 3")
    return best.join(enough, list(SERIES)).select(*SERIES, "inferred")


def interval_mismatch(bars: DataFrame) -> DataFrame:
    """Series whose declared interval isn't the one that their times show."""
    return inferred_intervals(bars).withColumn("declared", declared_seconds(F.col("interval"))).filter(F.col("declared").isNotNull() & (F.col("declared") != F.col("inferred")))


def missing_candles(bars: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Steps in file order that are longer than one and a half intervals: series, pos, ts, code, severity, missing."""
    step = F.coalesce(declared_seconds(F.col("interval")), F.col("inferred"))
    calendar = F.col("interval").isin(*CALENDAR_INTERVALS) | (F.col("step") >= 86400)
    before = F.lag("ts").over(series_window())
    gaps = bars.select(*SERIES, "pos", "ts", before.alias("before"))
    gaps = gaps.join(inferred_intervals(bars), list(SERIES), "left").withColumn("step", step).withColumn("delta", F.unix_timestamp("ts") - F.unix_timestamp("before"))
    days = business_days(F.to_date("before"), F.to_date("ts"))
    by_calendar = F.when(days <= 1, "SESSION_BREAK").when(days <= limits.max_holiday_business_days, "HOLIDAY_BREAK").otherwise("MISSING_CANDLES")
    within_day = F.when(F.to_date("before") == F.to_date("ts"), "MISSING_CANDLES").otherwise("SESSION_BREAK")
    code = F.when(calendar, by_calendar).otherwise(within_day)
    out = gaps.filter(F.col("delta") > 1.5 * F.col("step")).select(*SERIES, "pos", "ts", code.alias("code"), F.greatest(F.lit(0), F.bround(F.col("delta") / F.col("step"), 0).cast("long") - 1).alias("missing"))
    return out.withColumn("severity", F.when(F.col("code") == "MISSING_CANDLES", WARNING).otherwise(INFO))


def zero_volume_runs(bars: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Series whose longest run of bars without volume is over the limit. A missing volume ends a run."""
    idle = bars.filter(F.col("volume") == 0).select(*SERIES, (F.col("pos") - F.row_number().over(series_window())).alias("island"))
    return idle.groupBy(*SERIES, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*SERIES).agg(F.max("n").alias("longest")).filter(F.col("longest") > limits.max_zero_volume_run)


def abnormal_gaps(bars: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Opens that lie further from the close before than the series' own spread of such gaps explains."""
    previous = F.lag("close").over(series_window())
    gap = F.try_divide(F.abs(F.col("open") - previous), F.abs(previous))
    rows = bars.select(*SERIES, "pos", "ts", gap.alias("gap"))
    seen = rows.filter(F.col("gap").isNotNull())
    centre = seen.groupBy(*SERIES).agg(F.median("gap").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n >= 10")
    spread = seen.join(centre, list(SERIES)).groupBy(*SERIES).agg(F.first("centre").alias("centre"), F.median(F.abs(F.col("gap") - F.col("centre"))).alias("mad"))
    cutoff = F.greatest(F.lit(limits.min_gap_pct), F.col("centre") + limits.gap_mad_multiplier * MAD_SCALE * F.col("mad"))
    return seen.join(spread, list(SERIES)).filter(F.col("gap") > cutoff).select(*SERIES, "pos", "ts", "gap")


def facts(bars: DataFrame) -> DataFrame:
    """Rows and time range of every series, and the interval that its times show."""
    plain = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return plain.join(inferred_intervals(bars), list(SERIES), "left")


def timezone_findings(files: DataFrame) -> DataFrame:
    """files: series, original_tz, mixed. Mixed offsets are an error, none at all a warning."""
    code = F.when(F.col("mixed"), "MIXED_TIMEZONE").when(F.col("original_tz").isNull(), "NAIVE_TIMEZONE")
    return files.select(*SERIES, code.alias("code"), F.when(F.col("mixed"), ERROR).otherwise(WARNING).alias("severity")).filter(F.col("code").isNotNull())


def column_findings(columns: list[str]) -> list[tuple[str, str, str]]:
    """(code, severity, column) of required columns that are absent and of columns that aren't known; from the schema alone."""
    known = {*REQUIRED, *SERIES, "pos"}
    return [("MISSING_COLUMN", ERROR, c) for c in REQUIRED if c not in columns] + [("EXTRA_COLUMN", INFO, c) for c in columns if c not in known]


def type_findings(bars: DataFrame) -> list[tuple[str, str, str]]:
    """(code, severity, column) of columns whose type isn't a time or a number."""
    kinds = dict(bars.dtypes)
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    out = [("DATETIME_UNPARSEABLE", ERROR, "ts")] if "ts" in kinds and not kinds["ts"].startswith(("timestamp", "date")) else []
    return out + [("NON_NUMERIC_COLUMN", ERROR, c) for c in REQUIRED[1:] if c in kinds and kinds[c] not in numeric and not kinds[c].startswith("decimal")]


def contracted(bars: DataFrame) -> DataFrame:
    """Bars with every required column and with ``columns`` and ``unparsed``, as a scan has them.

    A frame that isn't scanned has the columns of its schema; one of a wrong type is unparsed throughout.
    """
    if "columns" in bars.columns:
        return bars
    known = {*SERIES, "pos", "raw_datetime", "file"}
    wrong = {c for _, _, c in type_findings(bars)}
    names = ["datetime" if c == "ts" else c for c in bars.columns if c not in known]
    kind = lambda c: "timestamp" if c == "ts" else "double"
    fixed = {c: F.lit(None).cast(kind(c)) if c not in bars.columns else F.col(c).cast("string").try_cast(kind(c)) for c in REQUIRED if c not in bars.columns or c in wrong}
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return bars.withColumns({**fixed, "columns": strings(names), "unparsed": strings(["datetime" if c == "ts" else c for c in wrong])})


def schema_issues(bars: DataFrame) -> DataFrame:
    """Issues of whole series: required columns that are absent, others that aren't known, columns without a value that parses, time zones."""
    required = ["datetime", *REQUIRED[1:]]
    strings = F.array(*map(F.lit, required))
    #: For each column: rows that have it unparsed, and rows that have a value of it.
    counts = [x for c, v in zip(required, REQUIRED, strict=True) for x in (F.count_if(F.array_contains("unparsed", c)).alias(f"u_{c}"), F.count(v).alias(f"v_{c}"))]
    zone = F.nullif(F.regexp_extract("raw_datetime", OFFSET, 1), F.lit("")) if "raw_datetime" in bars.columns else F.lit(None).cast("string")
    known = F.col("raw_datetime").isNotNull() if "raw_datetime" in bars.columns else F.lit(False)
    per = bars.groupBy(*SERIES).agg(F.array_distinct(F.flatten(F.collect_set("columns"))).alias("names"), F.min(F.size(F.array_intersect("columns", strings))).alias("fewest"), F.collect_set(F.array_except(strings, "columns")).alias("absent"), F.count_if(known).alias("dated"), F.count(F.when(known, zone)).alias("zoned"), F.count_distinct(F.when(known, zone)).alias("zones"), *counts)
    one = lambda check, code, severity, field, n: F.when(n > 0, F.struct(F.lit(check).alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), field.cast("string").alias("field"), n.cast("long").alias("count")))
    absent, extra, none = F.sort_array(F.array_distinct(F.flatten("absent"))), F.array_sort(F.array_except("names", strings)), F.lit(None).cast("string")
    each = lambda names, code, severity: F.transform(names, lambda c: one("required_columns", code, severity, c, F.lit(1)))
    unread = lambda c, code: one("dtypes", code, ERROR, F.lit(c), F.when((F.col(f"u_{c}") > 0) & (F.col(f"v_{c}") == 0), 1).otherwise(0))
    mixed = (F.col("zones") > 1) | ((F.col("zones") == 1) & (F.col("zoned") < F.col("dated")))
    zoned = [one("timezone_consistency", "MIXED_TIMEZONE", ERROR, none, mixed.cast("int")), one("timezone_consistency", "NAIVE_TIMEZONE", WARNING, none, ((F.col("dated") > 0) & (F.col("zoned") == 0)).cast("int"))]
    found = F.concat(each(absent, "MISSING_COLUMN", ERROR), each(extra, "EXTRA_COLUMN", INFO), F.array_compact(F.array(unread("datetime", "DATETIME_UNPARSEABLE"), *[unread(c, "NON_NUMERIC_COLUMN") for c in REQUIRED[1:]], *zoned)))
    return per.select(*SERIES, F.explode(found).alias("f")).select(*SERIES, "f.*")


def all_issues(bars: DataFrame, limits: Thresholds = Thresholds(), samples: int = 0) -> DataFrame:
    """Every issue of every series by all ten checks: check, code, severity, field, count; with samples, the first positions of each.

    bars: of a scan, or any frame of candles; what it lacks of the required columns is an issue.
    """
    bars = contracted(bars)
    keys = [*SERIES, "check", "code", "severity", "field", "count"]
    none = F.lit(None).cast("string").alias("field")
    named = lambda df, check, code, severity, count: df.select(*SERIES, F.lit(check).alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), none, count.cast("long").alias("count"))
    at_bars = row_findings(bars, limits).unionByName(missing_candles(bars, limits).select(*SERIES, "pos", "ts", F.lit("missing_candles").alias("check"), "code", "severity", none))
    at_bars = at_bars.unionByName(abnormal_gaps(bars, limits).select(*SERIES, "pos", "ts", F.lit("abnormal_gaps").alias("check"), F.lit("ABNORMAL_GAP").alias("code"), F.lit(WARNING).alias("severity"), none))
    runs = zero_volume_runs(bars, limits)
    whole = named(runs, "value_domains", "ZERO_VOLUME_RUN", WARNING, F.col("longest")).unionByName(named(interval_mismatch(bars), "missing_candles", "INTERVAL_MISMATCH", WARNING, F.lit(1))).unionByName(schema_issues(bars))
    if not samples:
        return at_bars.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("count")).unionByName(whole)
    counted = issues(at_bars, samples)
    return counted.unionByName(whole.withColumn("samples", F.lit(None).cast(counted.schema["samples"].dataType)))


def verdicts(bars: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, interval, errors, warnings, verdict of every series of bars."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).cast("long")
    sums = found.groupBy(*SERIES).agg(of(ERROR).alias("errors"), of(WARNING).alias("warnings"))
    every = bars.select(*SERIES).distinct().join(sums, list(SERIES), "left").na.fill(0, ["errors", "warnings"])
    return every.withColumn("verdict", _verdict())


def _verdict() -> Column:
    return F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")


#: The checks in the order of a report.
TEN = ("required_columns", "dtypes", "missing_values", "chronological_order", "duplicates", "timezone_consistency", "ohlc_relationships", "value_domains", "missing_candles", "abnormal_gaps")


def dataset_facts(bars: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """facts of every series, and what its file tells: source, sha256, columns, declared interval and time zone; null where bars don't come from files.

    digests: file and sha256, one row a file.
    """
    scanned = {"file", "raw_datetime"} <= set(bars.columns)
    rows = contracted(bars)
    zone = F.nullif(F.regexp_extract("raw_datetime", OFFSET, 1), F.lit("")) if scanned else F.lit(None).cast("string")
    dated = F.col("raw_datetime").isNotNull() if scanned else F.lit(False)
    told = rows.groupBy(*SERIES).agg(
        (F.min("file") if scanned else F.min(F.lit(None).cast("string"))).alias("source"),
        F.min("columns").alias("columns"),
        F.count_distinct(F.when(dated, zone)).alias("__zones"),
        F.max(F.when(dated, zone)).alias("__zone"),
        F.coalesce(F.bool_or(dated & zone.isNull()), F.lit(False)).alias("__naive"),
    )
    told = told.withColumn("timezone", F.when((F.col("__zones") > 1) | ((F.col("__zones") == 1) & F.col("__naive")), "MIXED").otherwise(F.col("__zone"))).drop("__zones", "__zone", "__naive")
    sums = digests.select(F.col("file").alias("__file"), "sha256") if digests is not None else None
    told = told.join(sums, F.col("source") == F.col("__file"), "left").drop("__file") if sums is not None else told.withColumn("sha256", F.lit(None).cast("string"))
    fields = ("source", "sha256", "rows", "columns", "first_timestamp", "last_timestamp", "declared_interval", "inferred_interval_seconds", "timezone")
    out = facts(bars).join(told, list(SERIES)).withColumns({"first_timestamp": stamp(F.col("first_ts")), "last_timestamp": stamp(F.col("last_ts")), "declared_interval": F.col("interval"), "inferred_interval_seconds": F.col("inferred")})
    return out.select(*SERIES, F.struct(*fields).alias("dataset"))


def reports(bars: DataFrame, found: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row for each series: errors, warnings, verdict, dataset, checks (all TEN, with or without issues) and issues."""
    keys = list(SERIES)
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).cast("long")
    told = [c for c in ("check", "code", "severity", "field", "count", "samples") if c in found.columns]
    by_check = found.groupBy(*keys, "check").agg(of(ERROR).alias("errors"), of(WARNING).alias("warnings"), F.collect_list(F.struct(*told)).alias("issues"))
    listed = by_check.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("check", F.struct("errors", "warnings")))).alias("__by"), F.sort_array(F.flatten(F.collect_list("issues"))).alias("issues"))
    at = lambda c, n: F.coalesce(F.element_at("__by", c)[n], F.lit(0).cast("long"))
    checks = F.array(*[F.struct(F.lit(c).alias("check"), (at(c, "errors") == 0).alias("passed"), at(c, "errors").alias("errors"), at(c, "warnings").alias("warnings")) for c in TEN])
    out = dataset_facts(bars, digests).join(listed, keys, "left").withColumn("checks", checks)
    total = lambda n: F.aggregate("checks", F.lit(0).cast("long"), lambda sum_, c: sum_ + c[n])
    out = out.withColumns({"errors": total("errors"), "warnings": total("warnings"), "issues": F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType))})
    return out.select(*keys, "errors", "warnings", _verdict().alias("verdict"), "dataset", "checks", "issues")


def gate(bars: DataFrame, judged: DataFrame) -> DataFrame:
    """The bars of series that didn't fail."""
    return bars.join(judged.filter("verdict <> 'FAIL'").select(*SERIES), list(SERIES), "left_semi")


def _unclosed(bars: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("pos"))) == 1
    open_ = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return bars.withColumn("__drop", last & open_)


def drop_unclosed_tail(bars: DataFrame) -> DataFrame:
    """Without the last bar of each series if a price of it is missing; no other bar is touched."""
    return _unclosed(bars).filter(~F.col("__drop")).drop("__drop")


def lineage_records(bars: DataFrame, source: str, schema_version: str = "1.0.0") -> DataFrame:
    """What the record beside a series' file tells once its unclosed tail is dropped: rows, first and last time, and the time of the bar that was dropped, if one was."""
    kept = ~F.col("__drop")
    told = _unclosed(bars).groupBy(*SERIES).agg(
        F.count_if(kept).alias("rows"),
        iso8601(F.min(F.when(kept, F.col("ts")))).alias("first_timestamp"),
        iso8601(F.max(F.when(kept, F.col("ts")))).alias("last_timestamp"),
        iso8601(F.max(F.when(~kept, F.col("ts")))).alias("dropped_unclosed_tail"),
    )
    return told.select(F.lit(schema_version).alias("schema_version"), F.lit(source).alias("source"), *told.columns, F.lit("UTC").alias("storage_timezone"))
