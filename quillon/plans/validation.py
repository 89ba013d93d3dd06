"""Registered queries of the data-quality gate."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import stamp
from ..operators import validate as v
from ..sources import tables
from .market import BAR, T, bar, rounded
from .sql import BLOCKS, sql

REGISTRY: dict[str, tuple] = {}

BLOCKS |= {
    "allbars": """SELECT symbol, "interval", pos, ts, open, high, low, close, volume FROM bars_1h UNION ALL SELECT symbol || ' dirty', "interval", pos, ts, open, high, low, close, volume FROM dirty""",
    "v_row": " UNION ALL ".join(
        [f"""SELECT symbol, pos, ts, 'missing_values' AS chk, 'NULL_VALUE' AS code, '{'WARNING' if c == 'volume' else 'ERROR'}' AS severity, '{c}' AS field FROM allbars WHERE {c} IS NULL""" for c in v.REQUIRED]
        + ["""SELECT symbol, pos, ts, 'chronological_order', 'OUT_OF_ORDER', 'ERROR', NULL FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM allbars) WHERE ts < p"""]
        + ["""SELECT symbol, pos, ts, 'duplicates', 'DUPLICATE_TIMESTAMP', 'ERROR', NULL FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY pos) AS n FROM allbars) WHERE ts IS NOT NULL AND n > 1"""]
        + ["""SELECT symbol, pos, ts, 'duplicates', 'DUPLICATE_ROW', 'ERROR', NULL FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, open, high, low, close, volume ORDER BY pos) AS n FROM allbars) WHERE n > 1"""]
        + [f"""SELECT symbol, pos, ts, 'ohlc_relationships', '{code}', 'ERROR', NULL FROM allbars WHERE open + high + low + close IS NOT NULL AND {bad}""" for code, bad in (("HIGH_BELOW_LOW", "high < low"), ("HIGH_BELOW_OPEN", "high < open"), ("HIGH_BELOW_CLOSE", "high < close"), ("LOW_ABOVE_OPEN", "low > open"), ("LOW_ABOVE_CLOSE", "low > close"))]
        + [f"""SELECT symbol, pos, ts, 'value_domains', 'NON_POSITIVE_PRICE', 'ERROR', '{c}' FROM allbars WHERE {c} <= 0""" for c in v.PRICES]
        + ["""SELECT symbol, pos, ts, 'value_domains', 'NEGATIVE_VOLUME', 'ERROR', NULL FROM allbars WHERE volume < 0"""]
        + ["""SELECT symbol, pos, ts, 'abnormal_gaps', 'ABNORMAL_BAR_RANGE', 'WARNING', NULL FROM allbars WHERE (high - low) / nullif(abs(close), 0) > 0.25"""]
    ),
    "v_steps": """SELECT symbol, d, count(*) AS n FROM (SELECT symbol, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))::BIGINT AS d FROM allbars WHERE ts IS NOT NULL) WHERE d > 0 GROUP BY ALL""",
    "v_mode": """SELECT symbol, d AS inferred FROM v_steps WHERE symbol IN (SELECT symbol FROM allbars GROUP BY symbol HAVING count(ts) >= 3) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, d) = 1""",
    "v_holes": """SELECT symbol, pos, ts, CASE WHEN p::DATE = ts::DATE THEN 'MISSING_CANDLES' ELSE 'SESSION_BREAK' END AS code, greatest(0, round_even((epoch(ts) - epoch(p)) / 3600, 0)::BIGINT - 1) AS missing
        FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM allbars) WHERE epoch(ts) - epoch(p) > 5400""",
    "v_runs": """SELECT symbol, max(n) AS longest FROM (SELECT symbol, island, count(*) AS n FROM (SELECT symbol, pos - row_number() OVER (PARTITION BY symbol ORDER BY pos) AS island FROM allbars WHERE volume = 0) GROUP BY ALL) GROUP BY symbol HAVING max(n) > 5""",
    "v_gap0": """SELECT symbol, pos, ts, abs(open - p) / nullif(abs(p), 0) AS gap FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM allbars)""",
    "v_gap1": """SELECT symbol, median(gap) AS centre FROM v_gap0 WHERE gap IS NOT NULL GROUP BY symbol HAVING count(*) >= 10""",
    "v_gap2": """SELECT symbol, centre, median(abs(gap - centre)) AS mad FROM v_gap0 JOIN v_gap1 USING (symbol) WHERE gap IS NOT NULL GROUP BY ALL""",
    "v_gaps": """SELECT symbol, pos, ts, gap FROM v_gap0 JOIN v_gap2 USING (symbol) WHERE gap > greatest(0.02, centre + 8.0 * 1.4826 * mad)""",
    "v_issues": """SELECT symbol, chk, code, severity, field, count(*) AS n FROM v_row GROUP BY ALL
        UNION ALL SELECT symbol, 'value_domains', 'ZERO_VOLUME_RUN', 'WARNING', NULL, longest FROM v_runs
        UNION ALL SELECT symbol, 'missing_candles', 'INTERVAL_MISMATCH', 'WARNING', NULL, 1 FROM v_mode WHERE inferred <> 3600
        UNION ALL SELECT symbol, 'missing_candles', code, CASE code WHEN 'MISSING_CANDLES' THEN 'WARNING' ELSE 'INFO' END, NULL, count(*) FROM v_holes GROUP BY ALL
        UNION ALL SELECT symbol, 'abnormal_gaps', 'ABNORMAL_GAP', 'WARNING', NULL, count(*) FROM v_gaps GROUP BY ALL""",
    "v_judged": """SELECT symbol, coalesce(sum(n) FILTER (WHERE severity = 'ERROR'), 0) AS errors, coalesce(sum(n) FILTER (WHERE severity = 'WARNING'), 0) AS warnings
        FROM (SELECT DISTINCT symbol FROM allbars) LEFT JOIN v_issues USING (symbol) GROUP BY symbol""",
}


#: The scanned series of v_columns, v_timezone and v_full_verdict, and the same checks over them.
BLOCKS |= {name.replace("v_", "w_", 1): re.sub(r"\bv_", "w_", BLOCKS[name]).replace("allbars", "scanbars") for name in [*BLOCKS] if name.startswith("v_")}
BLOCKS |= {
    "scanbars": """SELECT symbol, "interval", pos, ts, CASE WHEN symbol <> 'click' THEN open END AS open, high, low, close, CASE WHEN symbol <> 'signup' THEN volume END AS volume,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE symbol WHEN 'view' THEN '' WHEN 'error' THEN CASE WHEN pos % 2 = 1 THEN '+05:30' ELSE 'Z' END ELSE '+00:00' END AS raw FROM bars_1h""",
    "w_row": f"""SELECT * FROM ({BLOCKS["w_row"]}) WHERE NOT (code = 'NULL_VALUE' AND field = 'volume' AND symbol = 'signup')""",
    "w_zones": r"""SELECT symbol, count(*) AS dated, count(z) AS zoned, count(DISTINCT z) AS zones FROM (SELECT symbol, nullif(regexp_extract(raw, '(Z|[+-]\d{2}:?\d{2})$', 1), '') AS z FROM scanbars) GROUP BY symbol""",
    "w_schema": """SELECT DISTINCT symbol, 'required_columns' AS chk, 'MISSING_COLUMN' AS code, 'ERROR' AS severity, 'volume' AS field, 1 AS n FROM scanbars WHERE symbol = 'signup'
        UNION ALL SELECT DISTINCT symbol, 'required_columns', 'EXTRA_COLUMN', 'INFO', 'adj close', 1 FROM scanbars WHERE symbol = 'signup'
        UNION ALL SELECT symbol, 'dtypes', 'NON_NUMERIC_COLUMN', 'ERROR', 'open', 1 FROM scanbars GROUP BY symbol HAVING count(open) = 0
        UNION ALL SELECT symbol, 'timezone_consistency', CASE WHEN zoned = 0 THEN 'NAIVE_TIMEZONE' ELSE 'MIXED_TIMEZONE' END, CASE WHEN zoned = 0 THEN 'WARNING' ELSE 'ERROR' END, NULL, 1 FROM w_zones
        WHERE zoned = 0 OR zones > 1 OR zoned < dated""",
    "w_issues": BLOCKS["w_issues"] + " UNION ALL SELECT symbol, chk, code, severity, field, n FROM w_schema",
}


def query(statement: str | None):
    def register(f):
        REGISTRY[f.__name__] = (f, statement)
        return f

    return register


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean series and, under names of their own, the same with defects."""
    dirty = tables.dirty_bars(spark, sf_dir)
    return tables.bars_1h(spark, sf_dir).unionByName(dirty.withColumn("symbol", F.concat("symbol", F.lit(" dirty"))))


def _check(name: str, check: str, title: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bar(v.row_findings(both(spark, sf_dir), checks=(check,)), "code", "severity", "field")

    run.__name__ = name
    run.__doc__ = title
    query(sql(f"SELECT {BAR}, code, severity, field FROM v_row WHERE chk = '{check}'"))(run)


_check("v_missing_values", "missing_values", "Missing values, by column.")
_check("v_order", "chronological_order", "Times before the bar before.")
_check("v_duplicates", "duplicates", "Times and rows that repeat.")
_check("v_ohlc", "ohlc_relationships", "Highs and lows that don't enclose.")
_check("v_domains", "value_domains", "Prices and volumes out of their domain.")
_check("v_bar_range", "abnormal_gaps", "Bars with a range out of proportion.")


@query(sql("SELECT symbol, longest::BIGINT AS longest FROM v_runs"))
def v_zero_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.zero_volume_runs(both(spark, sf_dir)).select("symbol", "longest")


@query(sql("SELECT symbol, inferred::BIGINT AS inferred FROM v_mode"))
def v_interval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.inferred_intervals(both(spark, sf_dir)).select("symbol", "inferred")


@query(sql(f"SELECT {BAR}, code, missing::BIGINT AS missing FROM v_holes"))
def v_missing_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(v.missing_candles(both(spark, sf_dir)), "code", "missing")


@query(sql("""SELECT symbol, code, count(*)::BIGINT AS n, sum(missing)::BIGINT AS missing FROM (
    SELECT symbol, greatest(0, round_even((epoch(ts) - epoch(p)) / 86400, 0)::BIGINT - 1) AS missing,
      CASE WHEN b <= 1 THEN 'SESSION_BREAK' WHEN b <= 3 THEN 'HOLIDAY_BREAK' ELSE 'MISSING_CANDLES' END AS code
    FROM (SELECT *, len(list_filter(generate_series(p::DATE, ts::DATE - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS b
          FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM bars_1d)) WHERE epoch(ts) - epoch(p) > 129600) GROUP BY ALL"""))
def v_calendar_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.missing_candles(tables.bars_1d(spark, sf_dir))
    return found.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))


@query(sql(f"SELECT {BAR}, round(gap, 6) AS gap FROM v_gaps"))
def v_abnormal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(v.abnormal_gaps(both(spark, sf_dir)), *rounded("gap"))


@query(sql("""SELECT symbol, chk AS "check", code, severity, field, count(*)::BIGINT AS count, list(pos::BIGINT ORDER BY pos)[1:10]::VARCHAR AS positions FROM v_row GROUP BY ALL"""))
def v_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.issues(v.row_findings(both(spark, sf_dir)))
    positions = F.concat(F.lit("["), F.array_join(F.transform("samples", lambda s: s.pos.cast("string")), ", "), F.lit("]"))
    return found.select("symbol", "check", "code", "severity", "field", "count", positions.alias("positions"))


@query(sql("SELECT symbol, errors::BIGINT AS errors, warnings::BIGINT AS warnings, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM v_judged"))
def v_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = both(spark, sf_dir)
    return v.verdicts(bars, v.all_issues(bars)).select("symbol", "errors", "warnings", "verdict")


@query(sql("""SELECT symbol, chk AS "check", coalesce(sum(n) FILTER (WHERE severity = 'ERROR'), 0)::BIGINT AS errors, coalesce(sum(n) FILTER (WHERE severity = 'WARNING'), 0)::BIGINT AS warnings FROM v_issues GROUP BY ALL"""))
def v_check_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).cast("long")
    return v.all_issues(both(spark, sf_dir)).groupBy("symbol", "check").agg(of("ERROR").alias("errors"), of("WARNING").alias("warnings"))


@query(sql(f"SELECT {BAR}, {T} FROM allbars WHERE symbol IN (SELECT symbol FROM v_judged WHERE errors = 0)"))
def gated_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = both(spark, sf_dir)
    return bar(v.gate(bars, v.verdicts(bars, v.all_issues(bars))), stamp(F.col("ts")).alias("ts"))


@query(sql("SELECT symbol, count(*)::BIGINT AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, any_value(inferred)::BIGINT AS inferred FROM allbars LEFT JOIN v_mode USING (symbol) GROUP BY symbol"))
def v_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.facts(both(spark, sf_dir)).select("symbol", "rows", stamp(F.col("first_ts")).alias("first_ts"), stamp(F.col("last_ts")).alias("last_ts"), "inferred")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as a scan of files gives them: one file without volume but with a column of its own, one whose opens don't parse, times with and without offsets."""
    bars, of = tables.bars_1h(spark, sf_dir), F.col("symbol")
    names = lambda *xs: F.array(*map(F.lit, xs))
    offset = F.when(of == "view", "").when(of == "error", F.when(F.col("pos") % 2 == 1, "+05:30").otherwise("Z")).otherwise("+00:00")
    prices = ("datetime", "open", "high", "low", "close")
    return bars.withColumns({
        "open": F.when(of != "click", F.col("open")),
        "volume": F.when(of != "signup", F.col("volume")),
        "columns": F.when(of == "signup", names(*prices, "adj close")).otherwise(names(*prices, "volume")),
        "unparsed": F.when(of == "click", names("open")).otherwise(F.array().cast("array<string>")),
        "raw_datetime": F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset),
    })


def _schema(*checks: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v.schema_issues(scanned(spark, sf_dir)).filter(F.col("check").isin(*checks)).select("symbol", "check", "code", "severity", "field", "count")

    return run


REGISTRY["v_columns"] = (_schema("required_columns", "dtypes"), sql("""SELECT symbol, chk AS "check", code, severity, field, n::BIGINT AS count FROM w_schema WHERE chk IN ('required_columns', 'dtypes')"""))
REGISTRY["v_timezone"] = (_schema("timezone_consistency"), sql("""SELECT symbol, chk AS "check", code, severity, field, n::BIGINT AS count FROM w_schema WHERE chk = 'timezone_consistency'"""))


@query(sql("SELECT symbol, errors::BIGINT AS errors, warnings::BIGINT AS warnings, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM w_judged"))
def v_full_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = scanned(spark, sf_dir)
    return v.verdicts(bars, v.all_issues(bars)).select("symbol", "errors", "warnings", "verdict")
