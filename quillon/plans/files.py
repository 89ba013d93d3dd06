"""Registered queries that go through files: written by the sinks, read back by the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import jsonschema
from ..functions.scalar import SERIES, stamp
from ..operators import context, metrics, sampler, screen, summary, teacher
from ..operators import indicators as ind
from ..operators import validate as v
from ..session import scratch_path
from ..sources import csv, records, sinks, tables
from . import corpus, validation
from .market import BAR, T, bar, r, rounded
from .sql import BLOCKS, sql

REGISTRY: dict[str, tuple] = {}

BLOCKS |= {
    "pair_rows": """SELECT symbol, pos, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'val' ELSE 'train' END AS split, pos % 19 <> 0 AS ok, active_high IS NULL OR pos % 11 = 0 AS contradicted,
        rsi IS NOT NULL AND cve IS NOT NULL AND pos % 5 <> 0 AND (active_high IS NULL OR pos % 6 <> 0) AS resolved FROM (SELECT *, (close - ema_20) / nullif(atr, 0) AS cve FROM facts)""",
}


def query(statement: str):
    def register(f):
        REGISTRY[f.__name__] = (f, statement)
        return f

    return register


def _scanned(spark: SparkSession, bars: DataFrame, offset: str = "") -> DataFrame:
    """The candles after a way through CSV files, one for each series."""
    text = F.col("raw_datetime") if "raw_datetime" in bars.columns else F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
    path = scratch_path(spark, "candles")
    sinks.write_series(bars.select(*SERIES, "pos", text.alias("datetime"), *csv.COLUMNS[1:]), path)
    return csv.scan(spark, path)


@query(sql(f"SELECT {BAR}, \"interval\", {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM bars_1h UNION ALL SELECT {BAR}, \"interval\", {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM bars_1d"))
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and intervals from paths, rows in file order, values as written."""
    bars = _scanned(spark, tables.bars_1h(spark, sf_dir).unionByName(tables.bars_1d(spark, sf_dir)))
    return bar(bars, "interval", stamp(F.col("ts")).alias("ts"), *rounded("open", "high", "low", "close", "volume"))


@query(validation.REGISTRY["v_verdict"][1])
def csv_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten checks over scanned files, clean and with defects."""
    bars = _scanned(spark, validation.both(spark, sf_dir), "+00:00")
    return v.verdicts(bars, v.all_issues(bars)).select("symbol", "errors", "warnings", "verdict")


@query(sql(r"""SELECT symbol, mixed, CASE WHEN mixed THEN 'MIXED' ELSE z END AS original_tz FROM (SELECT symbol, max(z) AS z, count(DISTINCT z) > 1 OR (count(DISTINCT z) = 1 AND count(z) < count(*)) AS mixed
    FROM (SELECT symbol, nullif(regexp_extract(raw, '(Z|[+-]\d{2}:?\d{2})$', 1), '') AS z FROM scanbars) GROUP BY symbol)"""))
def csv_timezones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv.timezones(_scanned(spark, validation.scanned(spark, sf_dir))).select("symbol", "mixed", "original_tz")


@query(sql("SELECT symbol, pos::BIGINT AS pos FROM bars_1h WHERE pos % 3 = 2"))
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after two commits to a checkpoint."""
    jobs, path = bar(tables.bars_1h(spark, sf_dir)), scratch_path(spark, "checkpoint")
    for part in (0, 1):
        records.append_checkpoint(jobs.filter(F.col("pos") % 3 == part), path)
    return summary.pending(jobs, records.read_checkpoint(spark, path, "symbol string, pos bigint"), ("symbol", "pos"))


def _judged(spark: SparkSession, sf_dir: str, spec: metrics.GateSpec) -> DataFrame:
    answers, examples = corpus._answers(spark, sf_dir)
    return teacher.corpus(teacher.score(teacher.parse(answers), examples), spec, val_start="2024-01-20")


@query(sql("SELECT ok AND NOT contradicted AS accepted, split, count(*)::BIGINT AS rows FROM pair_rows GROUP BY ALL"))
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows from files of their own, by the gate against contradictions."""
    path = scratch_path(spark, "corpus")
    sinks.write_corpus(_judged(spark, sf_dir, metrics.GateSpec(require_grounded=False)), f"{path}/accepted", f"{path}/rejected")
    kept, gone = (records.read_records(spark, f"{path}/{x}", "accepted boolean, split string") for x in ("accepted", "rejected"))
    return kept.union(gone).groupBy("accepted", "split").agg(F.count(F.lit(1)).alias("rows"))


@query(sql("SELECT 'compact' AS view, split, count(*)::BIGINT AS pairs, (3 * count(*))::BIGINT AS messages FROM pair_rows WHERE ok AND resolved GROUP BY split"))
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat pairs by view and split, from the folders of each."""
    path = scratch_path(spark, "pairs")
    rows = _judged(spark, sf_dir, metrics.GateSpec(require_grounded=False, forbid_contradictions=False))
    sinks.write_pairs(teacher.pairs(rows, "compact", "Describe the market.", "Context: {context}"), path)
    pairs = records.read_records(spark, path, "example_id string, messages array<struct<role:string,content:string>>, view string, split string")
    return pairs.groupBy("view", "split").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size("messages")).cast("long").alias("messages"))


@query(sql("SELECT symbol, sha256(string_agg(pos || ',' || volume::BIGINT || chr(10), '' ORDER BY pos)) AS sha256, sum(length(pos || ',' || volume::BIGINT) + 1)::BIGINT AS length FROM bars_1h GROUP BY symbol"))
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and bytes of a text file for each series."""
    path = scratch_path(spark, "texts")
    lines = tables.bars_1h(spark, sf_dir).withColumn("value", F.concat_ws(",", "pos", F.col("volume").cast("long")))
    lines.repartition("symbol").sortWithinPartitions("symbol", "pos").select("symbol", "value").write.partitionBy("symbol").text(path)
    return csv.digests(spark, path).select(F.regexp_extract("file", "/symbol=([^/]*)/", 1).alias("symbol"), "sha256", "length")


@query(sql("""SELECT symbol, CASE WHEN symbol NOT IN ('click', 'view') THEN any_value("interval") END AS lineage_interval, CASE WHEN symbol NOT IN ('click', 'view') THEN count(*)::BIGINT END AS rows FROM bars_1h GROUP BY symbol"""))
def lineage_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that the records beside the files tell: one record is cut off, one file has none."""
    series, path = tables.bars_1h(spark, sf_dir).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows")), scratch_path(spark, "lineage")
    record = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), *SERIES, "rows"))
    told = series.filter("symbol <> 'view'").select(F.col("symbol").alias("of"), F.when(F.col("symbol") == "click", F.substring(record, 1, 30)).otherwise(record).alias("value"))
    told.repartition("of").write.partitionBy("of").text(path)
    read = csv.lineage(spark, path).select("symbol", F.col("interval").alias("lineage_interval"), "rows")
    return series.select("symbol").join(read, "symbol", "left")


@query(sql(f"SELECT strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS datetime, {r('open', 'high', 'low', 'close', 'volume')} FROM bars_1h"))
def vendor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's names, columns of its own and local times."""
    bars = tables.bars_1h(spark, sf_dir).select(F.col("ts").alias("Date"), F.col("open").alias("Open.NS"), F.col("high").alias("High"), F.col("low").alias(" Low"), F.col("close").alias("CLOSE"), F.col("volume").alias("Volume"), F.lit(0.0).alias("Dividends"))
    return csv.normalise_vendor(bars, "Asia/Kolkata").select(stamp(F.col("datetime")).alias("datetime"), *rounded("open", "high", "low", "close", "volume"))


@query(sql("SELECT symbol, pos::BIGINT AS pos FROM weeks QUALIFY NOT (row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1 AND close IS NULL)",
    weeks="SELECT symbol || '#' || pos // 7 AS symbol, pos, CASE WHEN pos % 7 <> 3 AND pos % 14 <> 6 THEN close END AS close FROM bars_1h"))
def unclosed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of seven bars, half of them with an open last bar, all with a missing close within."""
    bars = tables.bars_1h(spark, sf_dir).withColumn("close", F.when((F.col("pos") % 7 != 3) & (F.col("pos") % 14 != 6), F.col("close")))
    return bar(v.drop_unclosed_tail(bars.withColumn("symbol", F.concat("symbol", F.lit("#"), F.floor(F.col("pos") / 7).cast("string")))))


@query(sql("""SELECT symbol, "interval", count(*) FILTER (WHERE NOT gone)::BIGINT AS rows, strftime(max(ts) FILTER (WHERE NOT gone), '%Y-%m-%dT%H:%M:%S+00:00') AS last_timestamp, strftime(max(ts) FILTER (WHERE gone), '%Y-%m-%dT%H:%M:%S+00:00') AS dropped
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1 AND close IS NULL AS gone FROM months) GROUP BY ALL""",
    months="""SELECT symbol || '#' || pos // 70 AS symbol, '1h' AS "interval", pos, ts, CASE WHEN pos % 7 <> 3 AND pos % 140 <> 69 THEN close END AS close FROM bars_1h"""))
def unclosed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of a dropped tail, and the rows that are left, through the record beside each series."""
    bars = tables.bars_1h(spark, sf_dir).withColumn("close", F.when((F.col("pos") % 7 != 3) & (F.col("pos") % 140 != 69), F.col("close")))
    path = scratch_path(spark, "lineage")
    sinks.write_lineage(v.lineage_records(bars.withColumn("symbol", F.concat("symbol", F.lit("#"), F.floor(F.col("pos") / 70).cast("string"))), "events"), path)
    return csv.lineage(spark, path).select("symbol", "interval", "rows", "last_timestamp", F.col("dropped_unclosed_tail").alias("dropped"))


@query(sql(r"""SELECT o_orderkey::BIGINT AS id, stem, regexp_extract(stem, '^(.*)_([^_]*)$', 1) AS symbol, regexp_extract(stem, '^(.*)_([^_]*)$', 2) AS "interval", 'plain' || o_orderkey AS bare_symbol, '1d' AS bare_interval FROM stems""",
    stems="""SELECT o_orderkey, translate(replace(CASE o_orderkey % 4 WHEN 0 THEN '^N' || o_orderkey WHEN 1 THEN 'INR' || o_orderkey || '=X' WHEN 2 THEN 'M&M/' || o_orderkey || '.NS' ELSE 'BRK_' || o_orderkey END, '^', 'IDX_'), '=/.&', '____')
        || '_' || CASE o_orderkey % 3 WHEN 0 THEN '1d' WHEN 1 THEN '1h' ELSE '15m' END AS stem FROM orders"""))
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe stems of symbols with marks, and what a scan takes from paths with them; a stem without an underscore is a symbol."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    of = lambda n, *names: F.element_at(F.array(*names), (key % n + 1).cast("int"))
    symbol = of(4, F.concat(F.lit("^N"), text), F.concat(F.lit("INR"), text, F.lit("=X")), F.concat(F.lit("M&M/"), text, F.lit(".NS")), F.concat(F.lit("BRK_"), text))
    rows = tables.table(spark, sf_dir, "orders").select(key.cast("long").alias("id"), csv.safe_stem(symbol, of(3, *map(F.lit, ("1d", "1h", "15m")))).alias("stem"), F.concat(F.lit("plain"), text).alias("bare"))
    name = csv.stem(F.concat(F.lit("/data/raw/"), F.col("stem"), F.lit(".csv")))
    return rows.select("id", "stem", csv.symbol_of(name).alias("symbol"), csv.interval_of(name).alias("interval"), csv.symbol_of(F.col("bare")).alias("bare_symbol"), csv.interval_of(F.col("bare")).alias("bare_interval"))


@query(sql("""SELECT symbol, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict, coalesce(issues, 0)::BIGINT AS issues, coalesce(found, 0)::BIGINT AS found
    FROM v_judged LEFT JOIN (SELECT symbol, count(*) AS issues, sum(n) AS found FROM v_issues GROUP BY symbol) USING (symbol)"""))
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all series as JSON files, read back."""
    reports = _reports(spark, validation.both(spark, sf_dir))
    return reports.select("symbol", "verdict", F.size("issues").cast("long").alias("issues"), F.aggregate("issues", F.lit(0).cast("long"), lambda n, i: n + i["count"]).alias("found"))


def _reports(spark: SparkSession, bars: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The reports of bars after a way through JSON files."""
    made, path = v.reports(bars, v.all_issues(bars, samples=10), digests), scratch_path(spark, "reports")
    sinks.report_json(made).select("report").write.text(path)
    return records.read_records(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema))


@query(sql(f"""SELECT symbol, c AS "check", coalesce(errors, 0)::BIGINT AS errors, coalesce(warnings, 0)::BIGINT AS warnings, coalesce(errors, 0) = 0 AS passed
    FROM (SELECT DISTINCT symbol FROM allbars), (SELECT unnest([{", ".join(f"'{c}'" for c in v.TEN)}]) AS c)
    LEFT JOIN (SELECT symbol AS s, chk, sum(n) FILTER (WHERE severity = 'ERROR') AS errors, sum(n) FILTER (WHERE severity = 'WARNING') AS warnings FROM v_issues GROUP BY ALL) ON s = symbol AND chk = c"""))
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten checks of the reports of scanned files, those that found nothing included."""
    reports = _reports(spark, _scanned(spark, validation.both(spark, sf_dir), "+00:00"))
    return reports.select("symbol", F.explode("checks").alias("c")).select("symbol", "c.check", "c.errors", "c.warnings", "c.passed")


@query(f"""SELECT symbol, rows, first_ts, last_ts, inferred, '1h' AS declared, '+00:00' AS timezone, 'datetime,open,high,low,close,volume' AS columns, true AS digested FROM ({validation.REGISTRY["v_facts"][1]})""")
def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports of scanned files tell of these: their digest is that of the file's bytes."""
    bars, path = validation.both(spark, sf_dir), scratch_path(spark, "candles")
    sinks.write_series(bars.select(*SERIES, "pos", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("datetime"), *csv.COLUMNS[1:]), path)
    digests = csv.digests(spark, path)
    d = F.col("dataset")
    rows = _reports(spark, csv.scan(spark, path), digests).join(digests.select(F.col("file").alias("source"), F.col("sha256").alias("own")), d.source == F.col("source"), "left")
    return rows.select("symbol", d.rows.alias("rows"), d.first_timestamp.alias("first_ts"), d.last_timestamp.alias("last_ts"), d.inferred_interval_seconds.alias("inferred"), d.declared_interval.alias("declared"), d.timezone.alias("timezone"), F.array_join(d.columns, ",").alias("columns"), F.coalesce(d.sha256 == F.col("own"), F.lit(False)).alias("digested"))


@query(corpus.REGISTRY["model_summary"][1])
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table as a CSV file with its fixed columns, read back by their names."""
    path = scratch_path(spark, "summary")
    sinks.write_summary(summary.summarise(corpus.stored(spark, sf_dir)), path)
    read = spark.read.option("header", True).schema(", ".join(f"{c} {'string' if c == 'model' else 'double'}" for c in sinks.SUMMARY_COLUMNS)).csv(path)
    return read.select("model", *[F.col(c).cast("long").alias(c) for c in ("examples", "calls")], *corpus.SUMMARY, "structure_agreement_rate")


@query(sql("SELECT 'symbol' AS dimension, symbol AS value, count(*)::BIGINT AS n FROM cand GROUP BY symbol UNION ALL SELECT 'stratum', stratum, count(*) FROM cand GROUP BY stratum"))
def sample_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by symbol and by stratum of examples from a file of records."""
    path = scratch_path(spark, "examples")
    sinks.write_records(corpus.sampled(spark, sf_dir), path)
    return sampler.describe(records.read_records(spark, path, "stratum string, source string, symbol string, interval string, pos int"))


@query(sql("SELECT symbol, coalesce(max(volume), 0) > 0 AND symbol <> 'view' AS has_volume FROM bars_1h GROUP BY symbol"))
def volume_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a series has any volume: scanned files, one of them without."""
    bars = tables.bars_1h(spark, sf_dir)
    rows = _scanned(spark, bars.withColumn("volume", F.when(F.col("symbol") != "view", F.col("volume"))))
    return ind.windowed(ind.recursions(rows)).groupBy("symbol").agg(F.bool_and("has_volume").alias("has_volume"))


@query(sql("""SELECT symbol, pos::BIGINT AS pos, split, 'system,user,assistant' AS roles, 'Describe the market.' AS system, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS as_of, round(close, 4) AS trigger_price, trend, true AS counted
    FROM pair_rows JOIN facts USING (symbol, pos) WHERE ok AND resolved"""))
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, the context inside the user's message and the analysis that the assistant gives, of every pair."""
    pairs = teacher.pairs(_judged(spark, sf_dir, metrics.GateSpec(require_grounded=False, forbid_contradictions=False)), "compact", "Describe the market.", "Context: {context}")
    m, of = F.col("messages"), F.split("example_id", "_1h#")
    said = lambda i: m[i].content
    context = F.regexp_replace(said(1), "^Context: ", "")
    counted = F.col("tokens") == F.floor(F.length(F.concat(said(0), said(1), said(2))) / 1.62)
    return pairs.select(
        of[0].alias("symbol"), of[1].cast("long").alias("pos"), "split", F.array_join(F.transform(m, lambda x: x.role), ",").alias("roles"), said(0).alias("system"), F.get_json_object(context, "$.as_of").alias("as_of"),
        F.get_json_object(said(2), "$.scenarios[0].trigger_price").cast("double").alias("trigger_price"), F.get_json_object(said(2), "$.market_structure").alias("trend"), (counted & F.get_json_object(context, "$.ohlcv_window").isNull()).alias("counted"),
    )


@query(corpus.REGISTRY["screen_universe"][1])
def screen_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen through its CSV file, where an empty text and a missing one are the same."""
    path, screened = scratch_path(spark, "screen"), screen.buckets(screen.measure(ind.indicators(tables.bars_1h(spark, sf_dir))), 100)
    sinks.write_screen(screened, path)
    return spark.read.option("header", True).schema(screened.schema).csv(path).drop("interval").withColumn("suspect", F.coalesce("suspect", F.lit("")))


@query(corpus.REGISTRY["corpus_totals"][1])
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a corpus through its JSON file."""
    path, totals = scratch_path(spark, "totals"), corpus.corpus_totals(spark, sf_dir)
    sinks.write_records(totals, path)
    return records.read_records(spark, path, ", ".join(f"{n} {t}" for n, t in totals.dtypes))


@query(sql("""SELECT symbol, pos::BIGINT AS pos, least(60, pos + 1)::BIGINT AS candles, trend, round(rsi, 2) AS rsi FROM strided JOIN facts USING (symbol, pos)"""))
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context documents as lines of JSON, read back under their own schema."""
    bars, path = tables.bars_1h(spark, sf_dir), scratch_path(spark, "contexts")
    made = context.contexts(bars, context.strided(bars, 20))
    context.context_json(made).select("context").write.text(path)
    read = spark.read.schema(made.schema["context"].dataType).json(path)
    return read.select("symbol", F.col("bar_index").cast("long").alias("pos"), F.size("ohlcv_window").cast("long").alias("candles"), "structure.trend", "indicators.rsi")


#: The outline that a model is shown of an answer, and the answer's data dictionary: fixed values.
OUTLINE = """- higher_timeframe_bias (BULLISH | BEARISH | NEUTRAL | UNAVAILABLE)
- higher_timeframe_rationale (string)
- market_structure (UPTREND | DOWNTREND | EXPANSION | CONTRACTION | RANGE | INSUFFICIENT_DATA)
- market_structure_explanation (string)
- market_state (TRENDING_UP | TRENDING_DOWN | RANGING | BREAKOUT | BREAKDOWN | REVERSAL | CHOPPY)
- setup_type (TREND_CONTINUATION_LONG | TREND_CONTINUATION_SHORT | RANGE_FADE_LONG | RANGE_FADE_SHORT | VOLATILITY_BREAKOUT_LONG | REVERSAL_LONG | REVERSAL_SHORT | NONE)
- supporting_evidence (list of object)
  - statement (string)
  - context_field (string)
  - value (string)
- conflicting_evidence (list of object)
  - statement (string)
  - context_field (string)
  - value (string)
- important_levels (list of object)
  - price (number)
  - role (string)
  - context_field (string)
  - note (string)
- scenarios (list of object)
  - name (string)
  - direction (string)
  - condition (string)
  - trigger_price (number)
  - invalidation_price (number)
  - expectation (string)
- confidence (number)
- reasoning_summary (string)"""
EVIDENCE = """| field | type | optional | description |
|-|-|-|-|
| evidence | array | yes | what is cited |
| evidence[].statement | string | yes |  |
| evidence[].context_field | string | yes |  |
| evidence[].value | string | yes |  |"""


def _lines(text: str) -> str:
    return f"SELECT i::BIGINT AS at, l[i] AS line FROM (SELECT string_split('{text}', chr(10)) AS l), range(1, {text.count(chr(10)) + 2}) t(i)"


def _numbered(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "at bigint, line string")


@query(_lines(OUTLINE))
def answer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict schema of an answer, from its Spark type, as the outline for prompts."""
    kind = StructType.fromDDL(f"a {teacher.ANALYSIS}")["a"].dataType
    return _numbered(spark, jsonschema.outline(jsonschema.strict(jsonschema.of_type(kind, metrics.VOCABULARY))))


@query(_lines(EVIDENCE))
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of a nested type, a line for each field."""
    return _numbered(spark, sinks.data_dictionary(StructType.fromDDL("evidence array<struct<statement:string,context_field:string,value:string>>"), {"evidence": "what is cited"}))


@query("SELECT event_type, count(*)::BIGINT AS rows, count(DISTINCT event_id)::BIGINT AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a checkpoint that stops between a batch and its commit, and is started again: no row is lost or comes twice."""
    from ..streaming import checkpoint

    path, state = scratch_path(spark, "records"), scratch_path(spark, "stream")
    events = tables.table(spark, sf_dir, "events")

    def stopped(session: SparkSession, at: str, batch_id: int) -> None:
        raise InterruptedError(f"stopped before the commit of batch {batch_id}")

    def run(write) -> None:
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
        stream.select("event_id", "event_type", "value").writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    try:
        run(checkpoint.append_once(path, stopped))
    except Exception as error:
        if "stopped before the commit" not in str(error):
            raise
    run(checkpoint.append_once(path))
    rows = checkpoint.committed(spark, path, "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))
