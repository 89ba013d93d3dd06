"""OHLCV files: scans that coerce and never repair, digests, lineage and names."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite
from ..operators.validate import OFFSET

COLUMNS = ("datetime", "open", "high", "low", "close", "volume")
#: What a scan tells of a row's file and texts, besides the candle: the gate reads it.
FILE_FACTS = ("columns", "unparsed", "raw_datetime")
#: Lines of a record at most; lines numbered by one task; blocks of files whose counts are broadcast, else they are shuffled.
RECORD_LINES, RANGE_LINES, BROADCAST_BLOCKS = 1_000, 1_000_000, 100_000
#: A comma and the field after it, which may be quoted.
_FIELD = r',(?:"[^"]*(?:""[^"]*)*"|[^,]*)'


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def symbol_of(name: Column) -> Column:
    """The part of a file's stem before its last underscore."""
    got = F.regexp_extract(name, r"^(.*)_([^_]*)$", 1)
    return F.when(got == "", name).otherwise(got)


def interval_of(name: Column) -> Column:
    got = F.regexp_extract(name, r"^(.*)_([^_]*)$", 2)
    return F.when(got == "", "1d").otherwise(got)


def safe_stem(symbol: Column, interval: Column) -> Column:
    """A file name for any symbol."""
    return F.concat(F.translate(F.replace(symbol, F.lit("^"), F.lit("IDX_")), "=/.&", "____"), F.lit("_"), interval)


def _folder(path: Column, key: str) -> Column:
    """The value of a folder key=value of a path, null without one; a path is escaped twice, by the writer and as an URI."""
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return plain(plain(F.nullif(F.regexp_extract(path, f"/{key}=([^/]*)/", 1), F.lit(""))))


def fields(line: Column) -> Column:
    """The fields of a line, unquoted."""

    def plain(x: Column) -> Column:
        x = F.substring(x, 2, 1 << 30)
        return F.when(x.startswith('"'), F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(0)), plain)


def _reader(spark: SparkSession) -> DataFrameReader:
    """A reader whose ranges of a file are the same at each pass: in a session of its own, since else they go by the cores there are at the time."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own.read


def _blocks(lines: DataFrame) -> DataFrame:
    """Of each block of a file: its first row number, the records and the open quotes before it, whether quotes of the file go over lines and all close, and the file's first line."""
    own = lines.groupBy("file", "__block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"), F.sum("__odd").alias("__odds"), F.min_by("value", "__row").alias("__line"))
    # As many rows as a file has blocks.
    w = Window.partitionBy("file").orderBy("__block")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    so_far, odds = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), F.sum("__odds").over(whole)
    return own.select("file", "__block", "__first", so_far("__n").alias("__base"), (so_far("__odds") % 2).alias("__open"), ((odds > 0) & (odds % 2 == 0)).alias("__quoted"), F.first("__line").over(w).alias("__header"))


def _joined(lines: DataFrame) -> DataFrame:
    """The records of files whose quoted fields have line breaks: file, __at (of its first line), __header, value and pos.

    Lines are looked at by block, records by their first line. One of more than RECORD_LINES lines is
    no record, and its lines are records each, as are all lines of a file with a quote that never closes.
    """
    here = Window.partitionBy("file", "__block").orderBy("__at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("__open") + F.coalesce(F.sum("__odd").over(before), F.lit(0))) % 2 == 1
    lines = lines.select("file", "__block", "__at", "__header", "value", inside.alias("__inside"))
    lines = lines.withColumn("__start", F.max(F.when(~F.col("__inside"), F.col("__at"))).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    last = lines.groupBy("file", "__block").agg(F.max("__start").alias("__last"))
    carried = last.select("file", "__block", F.last("__last", ignorenulls=True).over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    lines = lines.join(carried, ["file", "__block"]).withColumn("__start", F.coalesce("__start", "__carried", F.lit(0)))
    long = lines.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > RECORD_LINES).select("file", "__start", F.lit(True).alias("__apart"))
    lines = lines.join(long, ["file", "__start"], "left").withColumn("__start", F.when(F.col("__apart"), F.col("__at")).otherwise(F.col("__start")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "value"))), lambda x: x["value"]), "\n")
    records = lines.groupBy("file", F.col("__start").alias("__at")).agg(F.first("__header").alias("__header"), text.alias("value"))
    # Records are numbered in ranges of their first lines, then ranges by their counts.
    records = records.withColumn("__range", F.floor(F.col("__at") / RANGE_LINES))
    order = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = records.groupBy("file", "__range").count().select("file", "__range", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("file", "__range").orderBy("__at"))
    return records.withColumn("__n", within).join(starts, ["file", "__range"]).select("file", "__header", "value", (F.col("__base") + F.col("__n") - 2).alias("pos"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """symbol, interval, pos (file row), ts, prices, volume and FILE_FACTS of every row of every CSV under path.

    Columns are found by the names in each file's own header, in any order: those that a file lacks
    are null, others are left out, and ``columns`` has all names for the gate to judge. What doesn't
    parse becomes null, and ``unparsed`` names its column. Symbol and interval come from folders
    symbol=... and interval=..., where there are such, else from the file's name. The header is a
    file's first line. Blank lines are skipped, also within quotes; a quoted field may go over lines.

    A file is read by many tasks, each a range of its bytes. A first pass, made here, counts the lines
    and open quotes of each range, and pos is the count before a line's range and its place there:
    the second pass gives it without a shuffle, unless files have quoted line breaks.
    """
    lines = _reader(spark).text(path).filter(F.trim("value") != "")
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), "value", (quotes % 2).alias("__odd"))
    blocks = _blocks(lines).persist(StorageLevel.DISK_ONLY)
    n, broken = blocks.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("__quoted"), F.lit(False))).first()
    lines = lines.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, ["file", "__block"]).withColumn("__at", F.col("__base") + F.col("__row") - F.col("__first"))
    rows = (lines.filter(~F.col("__quoted")) if broken else lines).select("file", "__header", "value", (F.col("__at") - 1).alias("pos"))
    if broken:
        rows = rows.union(_joined(lines.filter("__quoted")))
    rows = rows.filter("pos >= 0").withColumn("pos", F.col("pos").cast("int"))
    file = F.col("file")
    symbol, interval = F.coalesce(_folder(file, "symbol"), symbol_of(stem(file))), F.coalesce(_folder(file, "interval"), interval_of(stem(file)))
    rows = rows.select("*", symbol.alias("symbol"), interval.alias("interval"))
    header = F.transform(fields(F.replace(F.col("__header"), F.lit("\ufeff"), F.lit(""))), lambda x: F.lower(F.trim(x)))
    rows = rows.select("file", "symbol", "interval", "pos", header.alias("columns"), fields(F.col("value")).alias("__fields"))
    at = lambda c: F.array_position("columns", c).cast("int")
    text = lambda c: F.when(at(c) > 0, F.nullif(F.trim(F.try_element_at("__fields", F.nullif(at(c), F.lit(0)))), F.lit("")))
    rows = rows.select("file", "symbol", "interval", "pos", "columns", *[text(c).alias(f"__{c}") for c in COLUMNS])
    number = lambda c: finite(F.col(f"__{c}").try_cast("double")).alias(c)
    rows = rows.select("*", F.try_to_timestamp(F.col("__datetime")).alias("ts"), *[number(c) for c in COLUMNS[1:]])
    value = lambda c: F.col("ts" if c == "datetime" else c)
    unparsed = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull() & value(c).isNull(), F.lit(c)) for c in COLUMNS]))
    return rows.select("file", "symbol", "interval", "ts", *COLUMNS[1:], F.col("__datetime").alias("raw_datetime"), "pos", "columns", unparsed.alias("unparsed"))


def timezones(rows: DataFrame) -> DataFrame:
    """original_tz and mixed of every file: the offset all its times have, MIXED for several, null for none."""
    offset = F.nullif(F.regexp_extract("raw_datetime", OFFSET, 1), F.lit(""))
    per = rows.filter(F.col("raw_datetime").isNotNull()).groupBy("file", "symbol", "interval").agg(F.countDistinct(offset).alias("n"), F.max(offset).alias("tz"), F.bool_or(offset.isNull()).alias("some_naive"))
    mixed = (F.col("n") > 1) | ((F.col("n") == 1) & F.col("some_naive"))
    return per.select("file", "symbol", "interval", F.when(mixed, "MIXED").otherwise(F.col("tz")).alias("original_tz"), mixed.alias("mixed"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 and length of every file."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def lineage(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar records beside the files; broken ones give no row."""
    schema = "schema_version string, source string, symbol string, interval string, period string, storage_timezone string, rows bigint, first_timestamp string, last_timestamp string, dropped_unclosed_tail string, sha256 string, _corrupt_record string"
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    return raw.select(stem(F.col("_metadata.file_path")).alias("stem"), "*").filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def normalise_vendor(frame: DataFrame, tz: str | None = None) -> DataFrame:
    """Vendor columns under the fixed names, lower-cased; times of a zone become UTC. All fixed columns are required."""
    named = {c.lower().split(".")[0].strip(): c for c in frame.columns}
    named.setdefault("datetime", named.get("date", named.get("timestamp")))
    if missing := [c for c in COLUMNS if not named.get(c)]:
        raise ValueError(f"vendor frame lacks {missing}")
    out = frame.select(*[F.col(f"`{named[c]}`").alias(c) for c in COLUMNS])
    return out.withColumn("datetime", F.to_utc_timestamp("datetime", tz)) if tz else out
