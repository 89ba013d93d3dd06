"""What an analysis says against the context and against itself, and the corpus gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BULL_STATES, BEAR_STATES = ("TRENDING_UP", "BREAKOUT"), ("TRENDING_DOWN", "BREAKDOWN")
UNAVAILABLE, NONE, UNKNOWN_TREND = "UNAVAILABLE", "NONE", "INSUFFICIENT_DATA"


def agreement(rows: DataFrame, a: Column, trend: Column, htf_bias: Column, offered: Column) -> DataFrame:
    """Adds structure_agrees (null where the trend isn't known), htf_bias_agrees, setup_agrees and their sums.

    htf_bias: null without a closed higher period. offered: names of the setups in the context.
    """
    checks = {
        "structure_agrees": F.when(trend.isNotNull() & (trend != UNKNOWN_TREND), a.market_structure == trend),
        "htf_bias_agrees": a.higher_timeframe_bias == F.coalesce(htf_bias, F.lit(UNAVAILABLE)),
        "setup_agrees": F.when(F.size(offered) > 0, F.array_contains(offered, a.setup_type)).otherwise(a.setup_type == NONE),
    }
    out = rows.select("*", *[c.alias(n) for n, c in checks.items()])
    points = sum((F.coalesce(F.col(n).cast("int"), F.lit(0)) for n in checks), F.lit(0))
    known = sum((F.col(n).isNotNull().cast("int") for n in checks), F.lit(0))
    return out.withColumn("agreement_points", points).withColumn("agreement_comparable", known)


def contradictions(a: Column, close: Column, htf_bias: Column, offered: Column) -> Column:
    """The codes of what can't be true at once, each at most once, in a fixed order."""
    bull, bear = a.market_state.isin(*BULL_STATES), a.market_state.isin(*BEAR_STATES)
    inverted = lambda s: ((s.direction == "BULLISH") & (s.invalidation_price > s.trigger_price)) | ((s.direction == "BEARISH") & (s.invalidation_price < s.trigger_price))
    wrong_side = lambda x: ((x.role == "SUPPORT") & (x.price > close)) | ((x.role == "RESISTANCE") & (x.price < close))
    facts = lambda e: F.transform(e, lambda x: F.struct(x.context_field.alias("f"), x["value"].alias("v")))
    directions = F.array_distinct(F.transform(a.scenarios, lambda s: s.direction))
    tests = (
        ("STATE_VS_STRUCTURE", (bull & (a.market_structure == "DOWNTREND")) | (bear & (a.market_structure == "UPTREND"))),
        ("SETUP_VS_STATE", (a.setup_type.endswith("_LONG") & bear) | (a.setup_type.endswith("_SHORT") & bull)),
        ("SETUP_NOT_OFFERED", (a.setup_type != NONE) & ~F.array_contains(offered, a.setup_type)),
        ("LEVEL_SIDE_WRONG", F.exists(a.important_levels, lambda x: F.coalesce(wrong_side(x), F.lit(False)))),
        ("SCENARIOS_ONE_SIDED", (F.size(directions) < 2) & ~F.array_contains(directions, "NEUTRAL")),
        ("SCENARIO_LEVELS_INVERTED", F.exists(a.scenarios, lambda s: F.coalesce(inverted(s), F.lit(False)))),
        ("EVIDENCE_DOUBLE_COUNTED", F.arrays_overlap(facts(a.supporting_evidence), facts(a.conflicting_evidence))),
        ("CONFIDENCE_VS_EVIDENCE", (a.confidence >= 0.8) & (F.size(a.conflicting_evidence) > F.size(a.supporting_evidence))),
        ("HTF_CLAIMED_WHEN_ABSENT", htf_bias.isNull() & (a.higher_timeframe_bias != UNAVAILABLE)),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests]))


@dataclass(frozen=True)
class GateSpec:
    require_grounded: bool = True
    forbid_contradictions: bool = True
    require_first_attempt: bool = False


def gate_reasons(spec: GateSpec = GateSpec()) -> Column:
    """Why a scored row stays out of the corpus, in order; a failed call has that reason alone."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    tests = []
    if spec.require_grounded:
        tests += [("UNGROUNDED_NUMBER", c("hallucinated_numbers") > 0), ("UNRESOLVABLE_CITATION", c("unresolvable_fields") > 0), ("NUMBER_IN_PROSE", c("numbers_in_prose") > 0)]
    if spec.forbid_contradictions:
        tests.append(("CONTRADICTION", c("contradiction_count") > 0))
    if spec.require_first_attempt:
        tests.append(("NEEDED_REPAIR", ~F.coalesce(F.col("first_attempt_ok"), F.lit(False))))
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests])) if tests else F.array().cast("array<string>")
    return F.when(~F.coalesce(F.col("ok"), F.lit(False)), F.array(F.lit("CALL_FAILED"))).otherwise(reasons)


def judge(rows: DataFrame, spec: GateSpec = GateSpec()) -> DataFrame:
    """Adds reasons and accepted."""
    return rows.withColumn("reasons", gate_reasons(spec)).withColumn("accepted", F.size("reasons") == 0)


def split(as_of: Column, val_start: str = "2024-01-01") -> Column:
    """Temporal split by text comparison of ISO times."""
    return F.when(as_of >= F.lit(val_start), "val").otherwise("train")


#: Least numbers of entries in an analysis, and its closed vocabularies.
MIN_ENTRIES = {"supporting_evidence": 2, "conflicting_evidence": 1, "important_levels": 1, "scenarios": 2}
VOCABULARY = {
    "higher_timeframe_bias": ("BULLISH", "BEARISH", "NEUTRAL", "UNAVAILABLE"),
    "market_structure": ("UPTREND", "DOWNTREND", "EXPANSION", "CONTRACTION", "RANGE", "INSUFFICIENT_DATA"),
    "market_state": ("TRENDING_UP", "TRENDING_DOWN", "RANGING", "BREAKOUT", "BREAKDOWN", "REVERSAL", "CHOPPY"),
    "setup_type": ("TREND_CONTINUATION_LONG", "TREND_CONTINUATION_SHORT", "RANGE_FADE_LONG", "RANGE_FADE_SHORT", "VOLATILITY_BREAKOUT_LONG", "REVERSAL_LONG", "REVERSAL_SHORT", "NONE"),
}
ROLES, DIRECTIONS = ("SUPPORT", "RESISTANCE", "TRIGGER", "INVALIDATION"), ("BULLISH", "BEARISH", "NEUTRAL")


def shape_errors(a: Column) -> Column:
    """What of an analysis breaks its schema: the first twelve, as dotted places."""
    tests = [(f"{k}: at least {n} entries", F.coalesce(F.size(a[k]), F.lit(0)) < n) for k, n in MIN_ENTRIES.items()]
    tests += [(f"{k}: not an allowed value", ~F.coalesce(a[k].isin(*v), F.lit(False))) for k, v in VOCABULARY.items()]
    known = lambda x, allowed: F.coalesce(x.isin(*allowed), F.lit(False))
    tests.append(("important_levels.role: not an allowed value", F.exists(a.important_levels, lambda x: ~known(x.role, ROLES))))
    tests.append(("scenarios.direction: not an allowed value", F.exists(a.scenarios, lambda x: ~known(x.direction, DIRECTIONS))))
    tests.append(("confidence: not within 0 and 1", ~F.coalesce(a.confidence.between(0, 1), F.lit(False))))
    return F.slice(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for text, test in tests])), 1, 12)
