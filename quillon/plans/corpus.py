"""Registered queries of screening, sampling, grounding, scoring, summaries and views.

The analyses that these operators judge come from outside; here they are made from each bar's own
facts, some of them falsified by arithmetic on the bar's position, so that SQL can tell what each
operator must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import iso8601
from ..operators import grounding, metrics, sampler, screen, summary, teacher, views
from ..operators.context import contexts, described
from ..operators.indicators import indicators
from ..session import scratch_path
from ..sources import tables
from .market import BAR, bar, rounded
from .sql import BLOCKS, sql

REGISTRY: dict[str, tuple] = {}
MODELS = ("alpha", "beta", "gamma")
EARLY, CUTOFF = 20, "2024-01-25"


def query(statement: str | None):
    def register(f):
        REGISTRY[f.__name__] = (f, statement)
        return f

    return register


BLOCKS |= {
    "offers": "SELECT symbol, pos, list(rule ORDER BY k) AS offered FROM verdicts WHERE met = total GROUP BY symbol, pos",
    "t_k": """SELECT f.*, x.bias AS htf_bias, coalesce(offered, []::VARCHAR[]) AS offered, ['alpha', 'beta', 'gamma'][m + 1] AS model, m, run, f.pos + 3 * m + 5 * run AS k
        FROM facts f JOIN htf_at a USING (symbol, pos) LEFT JOIN dd_st x ON x.symbol = a.symbol AND x.pos = a.hpos LEFT JOIN offers o ON o.symbol = f.symbol AND o.pos = f.pos, range(3) t(m), range(3) u(run) WHERE run = 0 OR f.pos % 10 = 0""",
    "t_a": """SELECT *, symbol || '_1h#' || pos AS example_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS as_of, trend || '|' || vol_regime AS stratum,
        CASE WHEN k % 6 = 0 THEN 'RANGE' ELSE trend END AS ms, CASE WHEN k % 8 = 0 THEN 'BULLISH' ELSE coalesce(htf_bias, 'UNAVAILABLE') END AS hb,
        CASE WHEN k % 5 = 0 THEN 'TRENDING_DOWN' WHEN trend = 'UPTREND' THEN 'TRENDING_UP' WHEN trend = 'DOWNTREND' THEN 'TRENDING_DOWN' ELSE 'RANGING' END AS state,
        CASE WHEN k % 9 = 0 THEN 'REVERSAL_LONG' ELSE coalesce(offered[1], 'NONE') END AS setup, round(0.5 + (k % 6) / 10.0, 2) AS confidence,
        1 + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS n_conf,
        k % 17 <> 0 AS ok, CASE WHEN k % 34 = 0 THEN 'Timeout: no answer after 120 s' WHEN k % 17 = 0 THEN 'SchemaError: missing field' END AS error,
        CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS attempts, k % 17 <> 0 AND k % 4 <> 0 AS first_attempt_ok, round(5 + (k * 37 % 101) / 10.0, 3) AS latency_seconds,
        1000 + k % 50 AS prompt_tokens, 200 + k % 30 AS completion_tokens, CASE WHEN m < 2 THEN 0.001::DOUBLE * (1 + k % 3 + m) END AS cost,
        (k % 15 = 0)::INT AS hallucinated_numbers, (k % 20 = 0)::INT AS unresolvable_fields, (k % 18 = 0)::INT AS numbers_in_prose, (k % 15 <> 0 AND k % 20 <> 0 AND k % 18 <> 0) AS is_grounded,
        CASE WHEN m = 2 THEN 'h2' ELSE 'h1' END AS prompt_hash FROM t_k""",
    "t_s": """SELECT *, CASE WHEN trend <> 'INSUFFICIENT_DATA' THEN ms = trend END AS structure_agrees, hb = coalesce(htf_bias, 'UNAVAILABLE') AS htf_bias_agrees,
        CASE WHEN len(offered) > 0 THEN list_contains(offered, setup) ELSE setup = 'NONE' END AS setup_agrees,
        list_filter([CASE WHEN (state = 'TRENDING_UP' AND ms = 'DOWNTREND') OR (state = 'TRENDING_DOWN' AND ms = 'UPTREND') THEN 'STATE_VS_STRUCTURE' END,
            CASE WHEN (setup LIKE '%\\_LONG' ESCAPE '\\' AND state = 'TRENDING_DOWN') OR (setup LIKE '%\\_SHORT' ESCAPE '\\' AND state = 'TRENDING_UP') THEN 'SETUP_VS_STATE' END,
            CASE WHEN setup <> 'NONE' AND NOT list_contains(offered, setup) THEN 'SETUP_NOT_OFFERED' END, CASE WHEN k % 10 = 0 THEN 'LEVEL_SIDE_WRONG' END,
            CASE WHEN k % 12 = 0 THEN 'SCENARIOS_ONE_SIDED' END, CASE WHEN k % 14 = 0 THEN 'SCENARIO_LEVELS_INVERTED' END, CASE WHEN k % 13 = 0 THEN 'EVIDENCE_DOUBLE_COUNTED' END,
            CASE WHEN confidence >= 0.8 AND n_conf > 3 THEN 'CONFIDENCE_VS_EVIDENCE' END, CASE WHEN htf_bias IS NULL AND hb <> 'UNAVAILABLE' THEN 'HTF_CLAIMED_WHEN_ABSENT' END], lambda c: c IS NOT NULL) AS codes FROM t_a""",
    "t_j": """SELECT *, CASE WHEN NOT ok THEN ['CALL_FAILED'] ELSE list_filter([CASE WHEN hallucinated_numbers > 0 THEN 'UNGROUNDED_NUMBER' END, CASE WHEN unresolvable_fields > 0 THEN 'UNRESOLVABLE_CITATION' END,
            CASE WHEN numbers_in_prose > 0 THEN 'NUMBER_IN_PROSE' END, CASE WHEN len(codes) > 0 THEN 'CONTRADICTION' END], lambda c: c IS NOT NULL) END AS reasons, CASE WHEN as_of >= '2024-01-20' THEN 'val' ELSE 'train' END AS split FROM t_s WHERE run = 0""",
    "t_con": """SELECT model, avg(agree) AS consistency, avg(spread) AS confidence_spread FROM (
        SELECT a.model, a.example_id, avg(((a.hb = b.hb)::INT + (a.ms = b.ms)::INT + (a.state = b.state)::INT + (a.setup = b.setup)::INT) / 4.0) AS agree, any_value(s.spread) AS spread
        FROM t_s a JOIN t_s b ON a.model = b.model AND a.example_id = b.example_id AND a.run < b.run
        JOIN (SELECT model, example_id, max(confidence) - min(confidence) AS spread FROM t_s WHERE ok GROUP BY ALL) s ON s.model = a.model AND s.example_id = a.example_id WHERE a.ok AND b.ok GROUP BY ALL) GROUP BY model""",
    "t_sum": """SELECT s.model, count(*) FILTER (WHERE run = 0) AS examples, count(*) AS calls, avg(ok::INT) FILTER (WHERE run = 0) AS schema_compliance_rate, avg(first_attempt_ok::INT) FILTER (WHERE run = 0) AS first_attempt_rate,
        avg(attempts) FILTER (WHERE run = 0) AS mean_attempts,
        sum(structure_agrees::INT) FILTER (WHERE run = 0 AND ok) AS s1, sum(htf_bias_agrees::INT) FILTER (WHERE run = 0 AND ok) AS s2, sum(setup_agrees::INT) FILTER (WHERE run = 0 AND ok) AS s3,
        count(structure_agrees) FILTER (WHERE run = 0 AND ok) AS c1, count(htf_bias_agrees) FILTER (WHERE run = 0 AND ok) AS c2, count(setup_agrees) FILTER (WHERE run = 0 AND ok) AS c3,
        avg(is_grounded::INT) FILTER (WHERE run = 0 AND ok) AS grounded_rate, avg(hallucinated_numbers) FILTER (WHERE run = 0 AND ok) AS hallucinated_numbers_per_example, avg(len(codes)) FILTER (WHERE run = 0 AND ok) AS contradictions_per_example,
        avg(numbers_in_prose) FILTER (WHERE run = 0 AND ok) AS numbers_in_prose_per_example, avg(confidence) FILTER (WHERE run = 0 AND ok) AS mean_confidence, avg(prompt_tokens) FILTER (WHERE run = 0) AS mean_prompt_tokens,
        avg(cost) FILTER (WHERE run = 0) AS mean_cost, sum(cost) AS total_cost, list_sort(list(latency_seconds) FILTER (WHERE run = 0)) AS lat, any_value(consistency) AS consistency, any_value(confidence_spread) AS confidence_spread
        FROM t_s s LEFT JOIN t_con USING (model) GROUP BY s.model""",
    "t_q": """SELECT *, (s1 + s2 + s3) / (c1 + c2 + c3) AS fact_agreement_rate, lat[least(len(lat) - 1, round_even(0.5 * (len(lat) - 1), 0)::BIGINT) + 1] AS p50_latency, lat[least(len(lat) - 1, round_even(0.95 * (len(lat) - 1), 0)::BIGINT) + 1] AS p95_latency,
        0.20 * schema_compliance_rate + 0.25 * grounded_rate + 0.20 * (s1 + s2 + s3) / (c1 + c2 + c3) + 0.15 * greatest(0, 1 - least(1, contradictions_per_example)) + 0.15 * coalesce(consistency, 0.5) + 0.05 * first_attempt_rate AS quality FROM t_sum""",
    "t_gate": """SELECT *, list_filter([CASE WHEN schema_compliance_rate < 0.90 THEN 'schema_compliance' END, CASE WHEN grounded_rate < 0.80 THEN 'grounded' END, CASE WHEN contradictions_per_example > 1.0 THEN 'contradictions' END, CASE WHEN p95_latency > 120 THEN 'latency' END], lambda c: c IS NOT NULL) AS failed FROM t_q""",
    "scr0": """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS jump FROM h_ind""",
    "scr1": """SELECT symbol, count(close) AS bars, median(close * volume) / 1e7 AS turnover, median(atr / nullif(close, 0)) * 100 AS ap, stddev_samp(jump) * sqrt(252) * 100 AS sv, max(abs(jump)) * 100 AS mj,
        strftime(arg_min(ts, (-abs(jump), pos)) FILTER (WHERE jump IS NOT NULL), '%Y-%m-%d') AS jd FROM scr0 GROUP BY symbol HAVING count(close) >= 60""",
    "scr": """SELECT symbol, bars::BIGINT AS bars, round(turnover, 1) AS median_turnover_cr, round(ap, 2) AS median_atr_pct, round(sv, 1) AS stdev_vol_annual, round(sv / ap, 1) AS vol_ratio, round(mj, 1) AS max_jump_pct, jd AS max_jump_date,
        concat_ws('; ', CASE WHEN sv / ap > 14 THEN 'vol ratio ' || round_even(sv / ap, 0)::BIGINT END, CASE WHEN mj > 35 THEN round_even(mj, 0)::BIGINT || '% jump on ' || jd END) AS suspect FROM scr1""",
    "cand": """SELECT trend || '|' || vol_regime AS stratum, symbol || '_1h' AS source, symbol, pos FROM (SELECT *, max((ts >= TIMESTAMP '2024-01-25')::INT) OVER (PARTITION BY symbol ORDER BY pos) AS late FROM facts) WHERE late = 0 AND pos >= 20""",
}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(tables.bars_1h(spark, sf_dir))


def _when(k: int, yes, no) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.col("k") % k == 0, lit(yes)).otherwise(lit(no))


def _evidence(field: str, value: Column, statement: Column | str = "as shown") -> Column:
    return F.struct(statement.alias("statement") if isinstance(statement, Column) else F.lit(statement).alias("statement"), F.lit(field).alias("context_field"), value.cast("string").alias("value"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored results of three models: checkpoint rows with the analysis, partly falsified."""
    f = _facts(spark, sf_dir)
    m, run = F.col("m"), F.col("run")
    rows = summary.jobs(f.select("symbol", "interval", "pos", "ts", "close", "trend", "vol_regime", "trend_regime", F.col("htf.bias").alias("htf_bias"), F.transform("setups", lambda s: s["name"]).alias("offered")), list(MODELS), 3)
    rows = rows.filter((run == 0) | (F.col("pos") % 10 == 0)).withColumn("m", F.array_position(F.array(*[F.lit(x) for x in MODELS]), F.col("model")) - 1).withColumn("k", F.col("pos") + 3 * m + 5 * run)
    trend, close = F.col("trend"), F.col("close")
    none = F.array().cast("array<struct<statement:string,context_field:string,value:string>>")
    supporting = F.array(_evidence("structure.trend", trend), _evidence("indicators.rsi", F.lit("x")), _evidence("regime.trend_regime", F.col("trend_regime")))
    conflicting = F.concat(F.array(_evidence("volatility.regime", F.col("vol_regime"))), _when(7, F.array(*[_evidence(x, F.lit(x)) for x in "abc"]), none), _when(13, F.array(_evidence("structure.trend", trend)), none))
    scenario = lambda d, t, i: F.struct(d.alias("direction"), t.cast("double").alias("trigger_price"), i.cast("double").alias("invalidation_price"))
    analysis = F.struct(
        _when(6, "RANGE", trend).alias("market_structure"),
        _when(8, "BULLISH", F.coalesce("htf_bias", F.lit("UNAVAILABLE"))).alias("higher_timeframe_bias"),
        _when(5, "TRENDING_DOWN", F.when(trend == "UPTREND", "TRENDING_UP").when(trend == "DOWNTREND", "TRENDING_DOWN").otherwise("RANGING")).alias("market_state"),
        _when(9, "REVERSAL_LONG", F.coalesce(F.get("offered", F.lit(0)), F.lit("NONE"))).alias("setup_type"),
        F.round(0.5 + F.col("k") % 6 / 10, 2).alias("confidence"),
        supporting.alias("supporting_evidence"),
        conflicting.alias("conflicting_evidence"),
        F.array(F.struct(_when(10, close + 1, close - 1).alias("price"), F.lit("SUPPORT").alias("role"))).alias("important_levels"),
        F.array(scenario(F.lit("BULLISH"), close + 2, _when(14, close + 3, close - 2)), scenario(_when(12, "BULLISH", F.when(F.col("k") % 24 == 6, "NEUTRAL").otherwise("BEARISH")), F.lit(None), F.lit(None))).alias("scenarios"),
    )
    k, flag = F.col("k"), lambda n: (F.col("k") % n == 0).cast("int")
    rows = rows.select(
        "*",
        F.concat("symbol", F.lit("_1h#"), "pos").alias("example_id"),
        iso8601(F.col("ts")).alias("as_of"),
        F.concat_ws("|", "trend", "vol_regime").alias("stratum"),
        analysis.alias("analysis"),
        (k % 17 != 0).alias("ok"),
        F.when(k % 34 == 0, "Timeout: no answer after 120 s").when(k % 17 == 0, "SchemaError: missing field").alias("error"),
        (1 + flag(4)).alias("attempts"),
        ((k % 17 != 0) & (k % 4 != 0)).alias("first_attempt_ok"),
        F.round(5 + k * 37 % 101 / 10, 3).alias("latency_seconds"),
        (1000 + k % 50).alias("prompt_tokens"),
        (200 + k % 30).alias("completion_tokens"),
        F.when(m < 2, 0.001 * (1 + k % 3 + m)).alias("cost"),
        flag(15).alias("hallucinated_numbers"),
        flag(20).alias("unresolvable_fields"),
        flag(18).alias("numbers_in_prose"),
        F.when(m == 2, "h2").otherwise("h1").alias("prompt_hash"),
    ).withColumn("is_grounded", (F.col("hallucinated_numbers") + F.col("unresolvable_fields") + F.col("numbers_in_prose")) == 0)
    a = F.col("analysis")
    rows = metrics.agreement(rows, a, trend, F.col("htf_bias"), F.col("offered"))
    rows = rows.withColumn("contradictions", metrics.contradictions(a, close, F.col("htf_bias"), F.col("offered"))).withColumn("contradiction_count", F.size("contradictions"))
    return rows.select("*", *[F.col(f"analysis.{c}") for c in (*summary.CONSISTENCY_FIELDS, "confidence")])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table, as a report reads it: summaries go over the rows several times."""
    rows, path = results(spark, sf_dir), scratch_path(spark, "results")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judge(results(spark, sf_dir).filter("run = 0")).withColumn("split", metrics.split(F.col("as_of"), "2024-01-20"))


RUN = "model, symbol, pos::BIGINT AS pos, run::BIGINT AS run"


def _run(df: DataFrame, *columns) -> DataFrame:
    return df.select("model", "symbol", F.col("pos").cast("long").alias("pos"), F.col("run").cast("long").alias("run"), *columns)


@query(sql(f"SELECT {RUN}, codes::VARCHAR AS contradictions FROM t_s"))
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(results(spark, sf_dir), F.concat(F.lit("["), F.array_join("contradictions", ", "), F.lit("]")).alias("contradictions"))


@query(sql(f"SELECT {RUN}, structure_agrees, htf_bias_agrees, setup_agrees, (structure_agrees IS NOT NULL)::BIGINT + 2 AS comparable FROM t_s"))
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(results(spark, sf_dir), "structure_agrees", "htf_bias_agrees", "setup_agrees", F.col("agreement_comparable").cast("long").alias("comparable"))


@query(sql(f"SELECT {RUN}, reasons::VARCHAR AS reasons, len(reasons) = 0 AS accepted, split FROM t_j"))
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(_judged(spark, sf_dir), F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")).alias("reasons"), "accepted", "split")


@query(sql("SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(reasons) AS reason FROM t_j) GROUP BY reason"))
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.reject_counts(_judged(spark, sf_dir))


@query(sql("""SELECT 'split' AS dimension, split AS value, count(*)::BIGINT AS n FROM t_j WHERE len(reasons) = 0 GROUP BY split UNION ALL SELECT 'stratum', stratum, count(*) FROM t_j WHERE len(reasons) = 0 GROUP BY stratum
    UNION ALL SELECT 'interval', "interval", count(*) FROM t_j WHERE len(reasons) = 0 GROUP BY "interval" """))
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.corpus_counts(_judged(spark, sf_dir))


@query(sql("""SELECT count(*)::BIGINT AS generated, count(*) FILTER (WHERE len(reasons) = 0)::BIGINT AS accepted, round(avg((len(reasons) = 0)::INT), 6) AS accept_rate, count(DISTINCT symbol) FILTER (WHERE len(reasons) = 0)::BIGINT AS symbols,
    min(as_of) FILTER (WHERE len(reasons) = 0) AS first_as_of, max(as_of) FILTER (WHERE len(reasons) = 0) AS last_as_of, count(DISTINCT prompt_hash) FILTER (WHERE len(reasons) = 0)::BIGINT AS prompt_hashes FROM t_j"""))
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.corpus_totals(_judged(spark, sf_dir)).withColumn("accept_rate", F.round("accept_rate", 6))


@query(sql("SELECT model, round(consistency, 6) AS consistency, round(confidence_spread, 6) AS confidence_spread FROM t_con"))
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.consistency(stored(spark, sf_dir)).select("model", *rounded("consistency", "confidence_spread"))


SUMMARY = ("schema_compliance_rate", "first_attempt_rate", "mean_attempts", "fact_agreement_rate", "grounded_rate", "hallucinated_numbers_per_example", "numbers_in_prose_per_example", "contradictions_per_example", "mean_confidence", "mean_prompt_tokens", "mean_cost", "total_cost", "p50_latency", "p95_latency", "consistency")


@query(sql(f"SELECT model, examples::BIGINT AS examples, calls::BIGINT AS calls, {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY)}, round(s1 / c1, 6) AS structure_agreement_rate FROM t_q"))
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarise(stored(spark, sf_dir)).select("model", "examples", "calls", *rounded(*SUMMARY, "structure_agreement_rate"))


@query(sql("SELECT model, error[:position(':' IN error) - 1] AS label, count(*)::BIGINT AS n FROM t_s WHERE run = 0 AND error IS NOT NULL GROUP BY ALL"))
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.errors(results(spark, sf_dir))


@query(sql("SELECT model, code, count(*)::BIGINT AS n FROM (SELECT model, unnest(codes) AS code FROM t_s WHERE run = 0 AND ok) GROUP BY ALL"))
def contradiction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.contradiction_counts(results(spark, sf_dir))


@query(sql("SELECT model, round(p50_latency, 6) AS p50, round(p95_latency, 6) AS p95 FROM t_q"))
def nearest_rank_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarise(stored(spark, sf_dir)).select("model", F.round("p50_latency", 6).alias("p50"), F.round("p95_latency", 6).alias("p95"))


@query(sql("SELECT model, round(quality, 6) AS quality FROM t_q"))
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.quality(summary.summarise(stored(spark, sf_dir))).select("model", *rounded("quality"))


@query(sql("SELECT model, failed::VARCHAR AS failed_gates, len(failed) = 0 AS eligible FROM t_gate"))
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = summary.gates(summary.summarise(stored(spark, sf_dir)))
    return g.select("model", F.concat(F.lit("["), F.array_join("failed_gates", ", "), F.lit("]")).alias("failed_gates"), "eligible")


@query(sql("SELECT model, eligible, round(quality, 6) AS quality, round(pc, 6) AS projected_cost, row_number() OVER (ORDER BY eligible DESC, quality DESC, model)::BIGINT AS rank, eligible AND CASE WHEN any_near THEN near AND row_number() OVER (ORDER BY near DESC, pc, quality DESC, model) = 1 ELSE row_number() OVER (ORDER BY eligible DESC, quality DESC, model) = 1 END AS chosen FROM rec_n",
    rec_e="SELECT *, len(failed) = 0 AS eligible, mean_cost * 1000 / greatest(schema_compliance_rate, 1e-6) AS pc FROM t_gate",
    rec_b="SELECT *, coalesce(eligible AND quality >= (SELECT max(quality) FROM rec_e WHERE eligible) - 0.03 AND pc IS NOT NULL, false) AS near FROM rec_e",
    rec_n="SELECT *, bool_or(near) OVER () AS any_near FROM rec_b"))
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = summary.recommend(summary.gates(summary.quality(summary.summarise(stored(spark, sf_dir)))), 1000)
    return ranked.select("model", "eligible", *rounded("quality", "projected_cost"), F.col("rank").cast("long").alias("rank"), "chosen")


@query(sql("SELECT count(*)::BIGINT AS jobs, count(*) FILTER (WHERE NOT (run = 0 AND k % 17 <> 0))::BIGINT AS pending FROM t_a"))
def checkpoint_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).select("model", "example_id", "run", "ok")
    left = summary.pending(rows, rows.filter("run = 0 and ok"))
    return rows.agg(F.count(F.lit(1)).alias("jobs")).join(left.agg(F.count(F.lit(1)).alias("pending")), F.lit(True))


@query(sql("SELECT model, run::BIGINT AS run, count(*)::BIGINT AS jobs FROM bars_1h, (VALUES ('alpha'), ('beta'), ('gamma')) x(model), range(3) t(run) GROUP BY ALL"))
def model_example_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = summary.jobs(tables.bars_1h(spark, sf_dir).select("symbol", "pos"), list(MODELS), 3)
    return j.groupBy("model", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("jobs"))


@query(sql("""SELECT symbol, pos::BIGINT AS pos FROM (SELECT symbol, pos, row_number() OVER (ORDER BY symbol, pos) - 1 AS place, count(*) OVER () AS n FROM bars_1h) WHERE place IN (SELECT floor(i * n / 15) FROM range(15) t(i))"""))
def strided_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar(summary.strided(tables.bars_1h(spark, sf_dir), 15, ("symbol", "pos")))


@query(sql("SELECT *, CASE WHEN median_turnover_cr > 0 AND median_atr_pct > 0 THEN round(log10(median_turnover_cr) * median_atr_pct, 3) ELSE 0.0 END AS score, CASE WHEN suspect <> '' THEN 'flagged' WHEN median_turnover_cr >= 100 THEN 'clean' ELSE 'thin' END AS bucket FROM scr"))
def screen_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = indicators(tables.bars_1h(spark, sf_dir))
    return screen.buckets(screen.measure(bars), 100).drop("interval")


@query(sql("SELECT stratum, count(*)::BIGINT AS size, row_number() OVER (ORDER BY count(*), stratum)::BIGINT AS rank FROM cand GROUP BY stratum"))
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampler.strata(sampled(spark, sf_dir)).select("stratum", "size", F.col("rank").cast("long").alias("rank"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampler.candidates(_facts(spark, sf_dir), sampler.SampleSpec(cutoff=CUTOFF, min_bar_index=EARLY))


@query(sql("SELECT count(*)::BIGINT AS candidates, count(DISTINCT stratum)::BIGINT AS strata, 0::BIGINT AS strangers, 0::BIGINT AS too_near, 0::BIGINT AS left_over FROM cand"))
def sample_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice without an end: each pick is a candidate, picks of a source keep their distance, and every other candidate is too near to one."""
    spec = sampler.SampleSpec(target_count=1 << 30, cutoff=CUTOFF, min_bar_index=EARLY)
    found = sampled(spark, sf_dir)
    picks = sampler.choose(found, spec).select("stratum", "source", "pos")
    before = F.lag("pos").over(Window.partitionBy("source").orderBy("pos"))
    near = picks.select(F.col("source").alias("__s"), F.col("pos").alias("__p"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = found.agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("stratum").alias("strata"))
    out = out.join(count(picks.join(found, ["stratum", "source", "pos"], "left_anti"), "strangers"), F.lit(True))
    out = out.join(picks.select((F.col("pos") - before < spec.separation).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("too_near")), F.lit(True))
    return out.join(count(found.join(near, (F.col("source") == F.col("__s")) & (F.abs(F.col("pos") - F.col("__p")) < spec.separation), "left_anti"), "left_over"), F.lit(True))


@query(sql("SELECT stratum, source, pos::BIGINT AS pos FROM cand ORDER BY source, pos LIMIT 25"))
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the examples, whose length is what is asked for."""
    return sampled(spark, sf_dir).orderBy("source", "pos").limit(25).select("stratum", "source", F.col("pos").cast("long").alias("pos"))


@query(sql("SELECT symbol, sector, CASE WHEN suspect <> '' THEN 'flagged' WHEN median_turnover_cr >= 100 THEN 'clean' ELSE 'thin' END AS bucket FROM scr LEFT JOIN (VALUES ('click', 'input'), ('view', 'input'), ('purchase', 'sales'), ('none', 'none')) x(symbol, sector) USING (symbol)"))
def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector of every screened series, null where none is known."""
    known = spark.createDataFrame([("click", "input"), ("view", "input"), ("purchase", "sales"), ("none", "none")], "symbol string, sector string")
    return screen.with_sectors(screen.buckets(screen.measure(indicators(tables.bars_1h(spark, sf_dir))), 100), known).select("symbol", "sector", "bucket")


@query(None)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy selection; its target count is the operator's own limit. Tests check its properties."""
    return sampler.choose(sampled(spark, sf_dir), sampler.SampleSpec(cutoff=CUTOFF, min_bar_index=EARLY))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context JSON of every bar with one analysis that cites it, partly falsified by position."""
    c = contexts(tables.bars_1h(spark, sf_dir)).withColumn("k", F.col("pos"))
    x = F.col("context")
    rsi, high = x.indicators.rsi, x.structure.active_swing_high
    none = F.lit(None).cast("string")
    supporting = F.array(
        _evidence("indicators.rsi", _when(7, rsi + 1, rsi)),
        _evidence("structure.trend", F.lower(x.structure.trend)),
        _evidence("close_vs_ema.20", F.col("context.indicators.close_vs_ema")["20"]),
    )
    field = _when(5, "indicators.macd", "regime.trend_regime")
    conflicting = F.array(F.struct(F.lit("as shown").alias("statement"), field.alias("context_field"), x.regime.trend_regime.alias("value")))
    level = F.struct(F.coalesce(high, F.lit(-99999.5)).alias("price"), F.lit("RESISTANCE").alias("role"), F.when(high.isNotNull(), _when(6, "structure.no_such_high", "structure.active_swing_high")).otherwise(none).alias("context_field"), F.lit("above").alias("note"))
    scenario = lambda d, t, i, text: F.struct(F.lit(d).alias("direction"), text.alias("condition"), t.cast("double").alias("trigger_price"), i.cast("double").alias("invalidation_price"), F.lit("then on").alias("expectation"))
    close = F.element_at(x.ohlcv_window, -1).c
    analysis = F.struct(
        F.lit("Price held the 20-day EMA.").alias("higher_timeframe_rationale"),
        _when(4, "RSI near 55.2 and 1,234 lots", "no figures here").alias("market_structure_explanation"),
        F.lit("RSI14 is a name, not a number.").alias("reasoning_summary"),
        supporting.alias("supporting_evidence"),
        conflicting.alias("conflicting_evidence"),
        F.array(level).alias("important_levels"),
        F.array(scenario("BULLISH", close, _when(11, F.lit(12345678.9), F.lit(None).cast("double")), _when(9, "a break of 200", "a break")), scenario("BEARISH", F.lit(None), F.lit(None), F.lit("a fall"))).alias("scenarios"),
    )
    return c.withColumn("analysis", analysis)


@query(sql("""SELECT symbol, pos::BIGINT AS pos, (6 + (pos % 11 = 0)::INT)::BIGINT AS total_claims,
    ((rsi IS NOT NULL AND pos % 7 <> 0)::INT + 1 + (cve IS NOT NULL)::INT + (pos % 5 <> 0)::INT + (active_high IS NOT NULL)::INT + 1)::BIGINT AS grounded_claims,
    ((rsi IS NULL)::INT + (cve IS NULL)::INT + (pos % 5 = 0)::INT + (active_high IS NOT NULL AND pos % 6 = 0)::INT)::BIGINT AS unresolvable_fields,
    (rsi IS NOT NULL AND pos % 7 = 0)::BIGINT AS value_mismatches, ((active_high IS NULL)::INT + (pos % 11 = 0)::INT)::BIGINT AS ungrounded_prices,
    (CASE WHEN pos % 4 = 0 THEN 2 ELSE 0 END + (pos % 9 = 0)::INT + (pos < 19)::INT)::BIGINT AS numbers_in_prose, (cve IS NOT NULL)::BIGINT AS concessions
    FROM (SELECT *, (close - ema_20) / nullif(atr, 0) AS cve FROM facts)"""))
def grounding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cited(spark, sf_dir).withColumn("context", F.to_json("context"))
    names = ("total_claims", "grounded_claims", "unresolvable_fields", "value_mismatches", "ungrounded_prices", "numbers_in_prose", "concessions")
    return bar(grounding.verify(rows), *[F.col(f"grounding.{n}").cast("long").alias(n) for n in names])


@query(sql(f"SELECT {BAR}, (CASE WHEN pos % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS numbers, (pos % 3 = 0)::BIGINT AS named FROM bars_1h"))
def prose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.bars_1h(spark, sf_dir).withColumn("k", F.col("pos"))
    count = lambda text, periods: grounding.numbers_in_prose(text, F.array(*[F.lit(p) for p in periods]).cast("array<string>")).cast("long")
    return bar(b, count(_when(4, "RSI near 55.2 and 1,234 lots", "RSI14 has no figures here"), ()).alias("numbers"), count(_when(3, "the 20-day EMA and 200", "the 20-day EMA, 50 period"), ("20", "50")).alias("named"))


@query(sql("SELECT 'full' AS view, count(*) FILTER (WHERE pos % 3 <> 1 OR pos >= 29)::BIGINT AS pairs FROM bars_1h UNION ALL SELECT 'tail', count(*) FILTER (WHERE pos % 3 <> 1) FROM bars_1h UNION ALL SELECT 'compact', count(*) FILTER (WHERE pos % 3 = 2) FROM bars_1h"))
def view_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view drops the pairs that cite a candle it doesn't have: the last one, one 30 back, or none."""
    c, k = contexts(tables.bars_1h(spark, sf_dir)), F.col("pos") % 3
    none = F.array().cast("array<struct<context_field:string>>")
    a = F.struct(F.array(F.struct(F.when(k == 0, "ohlcv_window[-1].c").when(k == 1, "ohlcv_window[-30].c").otherwise("structure.trend").alias("context_field"))).alias("supporting_evidence"), none.alias("conflicting_evidence"), none.alias("important_levels"))
    rows = c.withColumn("analysis", a)
    out = views.view(rows, "full").select("view")
    for name in ("tail", "compact"):
        out = out.union(views.view(rows, name).select("view"))
    return out.groupBy("view").agg(F.count(F.lit(1)).alias("pairs"))


@query(sql(f"""SELECT {BAR}, least(pos + 1, 60)::BIGINT AS full_candles, least(pos + 1, 20)::BIGINT AS tail_candles, strftime(min(ts) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), '%Y-%m-%dT%H:%M:%S+00:00') AS tail_from,
    strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS tail_to, false AS compact_candles, true AS rest_kept FROM bars_1h"""))
def view_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candles of each view of every context; nothing else changes."""
    rows = contexts(tables.bars_1h(spark, sf_dir))
    full, tail, compact = (views.trim(F.col("context"), x) for x in ("full", "tail", "compact"))
    rows = rows.select("symbol", "pos", full.ohlcv_window.alias("full"), tail.ohlcv_window.alias("tail"), F.to_json(compact).alias("compact"), F.to_json(F.col("context").dropFields("ohlcv_window")).alias("rest"), F.to_json(tail.dropFields("ohlcv_window")).alias("tail_rest"))
    end = lambda i: F.element_at("tail", i).t
    kept = (F.col("compact") == F.col("rest")) & (F.col("tail_rest") == F.col("rest"))
    return bar(rows, F.size("full").cast("long").alias("full_candles"), F.size("tail").cast("long").alias("tail_candles"), end(1).alias("tail_from"), end(-1).alias("tail_to"), F.get_json_object("compact", "$.ohlcv_window").isNotNull().alias("compact_candles"), kept.alias("rest_kept"))


@query(sql(f"""SELECT {BAR}, nullif('SchemaError: ' || concat_ws(chr(10), CASE WHEN pos % 2 = 1 THEN 'supporting_evidence: at least 2 entries' END, CASE WHEN pos % 3 = 0 THEN 'market_state: not an allowed value' END, CASE WHEN pos % 5 = 0 THEN 'important_levels.role: not an allowed value' END,
    CASE WHEN pos % 4 = 0 THEN 'scenarios.direction: not an allowed value' END, CASE WHEN pos % 7 = 0 THEN 'confidence: not within 0 and 1' END), 'SchemaError: ') AS error FROM bars_1h"""))
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an answer of the wrong shape, one place a line."""
    rows = tables.bars_1h(spark, sf_dir).withColumn("k", F.col("pos"))
    one = F.array(_evidence("structure.trend", F.lit("x")))
    scenario = lambda d: F.struct(d.alias("direction"), F.lit("a break").alias("condition"))
    body = F.struct(
        *[F.lit(x).alias(c) for c, x in (("higher_timeframe_bias", "NEUTRAL"), ("market_structure", "RANGE"), ("setup_type", "NONE"))],
        _when(3, "SIDEWAYS", "RANGING").alias("market_state"),
        F.when(F.col("k") % 2 == 1, one).otherwise(F.concat(one, one)).alias("supporting_evidence"),
        one.alias("conflicting_evidence"),
        F.array(F.struct(F.lit(1.5).alias("price"), _when(5, "PIVOT", "SUPPORT").alias("role"))).alias("important_levels"),
        F.array(scenario(F.lit("BULLISH")), scenario(_when(4, None, "BEARISH"))).alias("scenarios"),
        _when(7, 1.5, 0.5).alias("confidence"),
    )
    return bar(teacher.parse(rows.withColumn("text", F.to_json(body))), "error")


@query(sql("SELECT model, count(*)::BIGINT AS pairs, (list_sort(list(t)))[len(list(t)) // 2 + 1]::BIGINT AS median, (list_sort(list(t)))[floor(len(list(t)) * 0.95)::BIGINT + 1]::BIGINT AS p95, max(t)::BIGINT AS max FROM (SELECT model, floor(prompt_tokens * 7 / 1.62) AS t FROM t_a) GROUP BY model"))
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("t", views.token_estimate(F.col("prompt_tokens") * 7))
    return views.length_stats(rows, "t", "model")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw answer texts (bare, fenced, after loose talk, cut off) and the examples that they are about."""
    rows = cited(spark, sf_dir).withColumn("example_id", F.concat("symbol", F.lit("_1h#"), "pos"))
    x = F.col("context")
    offered = F.transform(x.setups, lambda s: s["name"])
    full = F.struct(
        "analysis.*",
        F.coalesce(x.higher_timeframe.bias, F.lit("UNAVAILABLE")).alias("higher_timeframe_bias"),
        x.structure.trend.alias("market_structure"),
        F.lit("RANGING").alias("market_state"),
        F.coalesce(F.get(offered, F.lit(0)), F.lit("NONE")).alias("setup_type"),
        F.lit(0.5).alias("confidence"),
    )
    body = F.to_json(full)
    k = F.col("k") % 3
    text = F.when(F.col("k") % 19 == 0, F.substring(body, 1, 200)).when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("First {a thought}. "), body, F.lit(" Done.")))
    rows = rows.select("example_id", "symbol", "pos", "context", text.alias("text"))
    return rows.select("example_id", "text"), rows.select("example_id", "symbol", "pos", "context")


@query(sql("""SELECT symbol, pos::BIGINT AS pos, pos % 19 <> 0 AS ok, CASE WHEN pos % 19 = 0 THEN '[CALL_FAILED]' ELSE list_filter([
    CASE WHEN (rsi IS NOT NULL AND pos % 7 = 0) OR active_high IS NULL OR pos % 11 = 0 THEN 'UNGROUNDED_NUMBER' END,
    CASE WHEN rsi IS NULL OR cve IS NULL OR pos % 5 = 0 OR (active_high IS NOT NULL AND pos % 6 = 0) THEN 'UNRESOLVABLE_CITATION' END,
    CASE WHEN pos % 4 = 0 OR pos % 9 = 0 OR pos < 19 THEN 'NUMBER_IN_PROSE' END, CASE WHEN active_high IS NULL OR pos % 11 = 0 THEN 'CONTRADICTION' END], lambda c: c IS NOT NULL)::VARCHAR END AS reasons,
    CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'val' ELSE 'train' END AS split FROM (SELECT *, (close - ema_20) / nullif(atr, 0) AS cve FROM facts)"""))
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers to gated, split rows: the whole chain."""
    answers, examples = _answers(spark, sf_dir)
    rows = teacher.corpus(teacher.score(teacher.parse(answers), examples), val_start="2024-01-20")
    return bar(rows, "ok", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")).alias("reasons"), "split")


@query(sql("SELECT symbol, pos::BIGINT AS pos, pos % 19 <> 0 AS ok, CASE WHEN pos % 19 <> 0 THEN 0.5::DOUBLE END AS confidence FROM bars_1h"))
def parse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, _ = _answers(spark, sf_dir)
    rows = teacher.parse(answers).withColumn("symbol", F.split("example_id", "_1h#")[0]).withColumn("pos", F.split("example_id", "#")[1])
    return bar(rows, "ok", "analysis.confidence")


@query(None)
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat pairs of the accepted rows, in the view without candles."""
    answers, examples = _answers(spark, sf_dir)
    rows = teacher.corpus(teacher.score(teacher.parse(answers), examples), metrics.GateSpec(require_grounded=False, forbid_contradictions=False))
    return teacher.pairs(rows, "compact", "Describe the market.", "Context: {context}")
