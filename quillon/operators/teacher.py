"""From raw answers to a corpus: parse, check the shape, verify, score, gate, split, render.

The calls themselves are outside; their texts come in as a table, one row for each call. Regating is
running the tail of this chain again with another GateSpec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DATASET_SCHEMA_VERSION
from . import grounding, metrics, views

_EVIDENCE = "array<struct<statement:string,context_field:string,value:string>>"
ANALYSIS = (
    "struct<higher_timeframe_bias:string,higher_timeframe_rationale:string,market_structure:string,market_structure_explanation:string,market_state:string,setup_type:string,"
    f"supporting_evidence:{_EVIDENCE},conflicting_evidence:{_EVIDENCE},"
    "important_levels:array<struct<price:double,role:string,context_field:string,note:string>>,"
    "scenarios:array<struct<name:string,direction:string,condition:string,trigger_price:double,invalidation_price:double,expectation:string>>,"
    "confidence:double,reasoning_summary:string>"
)


#: A scored row as it is kept between runs, but for its context.
SCORED = (
    "model string, example_id string, run int, symbol string, interval string, stratum string, as_of string, ok boolean, error string, attempts int, first_attempt_ok boolean, "
    "latency_seconds double, prompt_tokens int, completion_tokens int, cost double, prompt_hash string, structure_agrees boolean, htf_bias_agrees boolean, setup_agrees boolean, "
    "agreement_points int, agreement_comparable int, grounded_claims int, total_claims int, hallucinated_numbers int, unresolvable_fields int, numbers_in_prose int, is_grounded boolean, "
    f"contradictions array<string>, contradiction_count int, analysis {ANALYSIS}"
)


def parse(answers: DataFrame, text: str = "text") -> DataFrame:
    """Adds analysis (null if the text has none of the right shape), errors and ok.

    Of several objects the last of the right shape is the answer; without one, the errors are those of the last.
    """
    found = answers.withColumn("__read", F.transform(views.objects(F.col(text)), lambda o: F.from_json(o, ANALYSIS)))
    judged = F.transform("__read", lambda a: F.struct(a.alias("a"), F.when(a.isNull(), F.array(F.lit("no JSON object in the answer"))).otherwise(metrics.shape_errors(a)).alias("e")))
    found = found.withColumn("__judged", judged)
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    found = found.withColumn("__best", F.coalesce(last(F.filter("__judged", lambda x: F.size(x.e) == 0)), last(F.col("__judged"))))
    errors = F.coalesce(F.col("__best.e"), F.array(F.lit("no JSON object in the answer")))
    out = found.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).withColumn("error", F.when(~F.col("ok"), F.concat(F.lit("SchemaError: "), F.array_join("errors", "\n"))))
    return out.withColumn("analysis", F.when(F.col("ok"), F.col("__best.a"))).drop("__read", "__judged", "__best")


def score(parsed: DataFrame, examples: DataFrame) -> DataFrame:
    """Scored rows: grounding, agreement, contradictions. examples: example_id and context, a struct.

    Answers without an example are left out. A failed answer has no scores.
    """
    rows = parsed.join(examples, "example_id").withColumn("context_json", F.to_json("context"))
    # A failed answer has no analysis; arrays of nulls would be counted, so it is verified as empty.
    rows = grounding.verify(rows, "context_json", "analysis")
    c, a, g = F.col("context"), F.col("analysis"), F.col("grounding")
    offered, htf = F.transform(c.setups, lambda s: s["name"]), c.higher_timeframe.bias
    rows = metrics.agreement(rows, a, c.structure.trend, htf, offered)
    codes = metrics.contradictions(a, F.element_at(c.ohlcv_window, -1).c, htf, offered)
    scored = lambda x: F.when(F.col("ok"), x)
    rows = rows.withColumn("contradictions", scored(codes)).withColumn("contradiction_count", scored(F.size("contradictions")))
    rows = rows.select("*", *[scored(g[n]).alias(n) for n in ("total_claims", "grounded_claims", "unresolvable_fields", "value_mismatches", "ungrounded_prices", "numbers_in_prose")])
    rows = rows.withColumn("hallucinated_numbers", F.col("ungrounded_prices") + F.col("value_mismatches"))
    grounded = (F.col("hallucinated_numbers") == 0) & (F.col("numbers_in_prose") == 0) & (F.col("unresolvable_fields") == 0)
    return rows.withColumn("is_grounded", grounded).drop("grounding", "context_json")


def corpus(scored: DataFrame, spec: metrics.GateSpec = metrics.GateSpec(), val_start: str = "2024-01-01") -> DataFrame:
    """Adds the gate's verdict, the split and the corpus's schema version."""
    return metrics.judge(scored, spec).withColumn("split", metrics.split(F.col("context.as_of"), val_start)).withColumns({"dataset_schema_version": F.lit(DATASET_SCHEMA_VERSION), "lineage": lineage(scored)})


#: What a corpus row tells of how it came about.
LINEAGE = ("model", "resolved_model", "served_by", "prompt_version", "prompt_hash", "structured_mode", "temperature", "engine_version", "context_schema_version", "params_fingerprint")


def lineage(rows: DataFrame) -> Column:
    """The lineage of scored rows: their own columns, and the versions and fingerprint that their contexts carry; null what they lack."""
    c = F.col("context")
    known = {"engine_version": c.engine_version, "context_schema_version": c.schema_version, "params_fingerprint": c.params_fingerprint}
    of = lambda n: known[n] if n in known else F.col(n).cast("string") if n in rows.columns else F.lit(None).cast("string")
    return F.struct(*[of(n).alias("teacher_model" if n == "model" else n) for n in LINEAGE])


def pairs(rows: DataFrame, view: str, system: str, user_template: str) -> DataFrame:
    """Chat pairs of the accepted rows in a view: example_id, split, view, messages, lineage, tokens."""
    rows = rows if "lineage" in rows.columns else rows.withColumn("lineage", lineage(rows))
    shown = views.view(rows.filter("accepted"), view).withColumn("messages", views.messages(system, user_template))
    chars = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m.content))
    return shown.select("example_id", "split", "view", "messages", "lineage", views.token_estimate(chars).alias("tokens"))
