"""Setup rules as data: each rule is a list of conditions over the columns of a described bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import EngineParams

#: A rule with this share of its conditions met, but not all, is a near miss.
NEAR_MISS = 0.66


@dataclass(frozen=True)
class Rule:
    name: str
    direction: str
    description: str
    conditions: tuple[tuple[str, Column], ...]
    trigger: Column
    invalidation: Column


def rules(params: EngineParams = EngineParams()) -> tuple[Rule, ...]:
    """The seven rules, in order. Names and condition texts are fixed values of the context document."""
    f, s = params.setup_fast_ema, params.setup_slow_ema
    c = F.col
    fast, slow, coiled = c(f"ema_{f}"), c(f"ema_{s}"), c("trend").isin("RANGE", "CONTRACTION")
    support, resistance, near = c("support"), c("resistance"), params.level_proximity_atr * c("atr")
    recent = lambda *kinds: c("last_event.type").isin(*kinds) & (c("pos") - c("last_event.index") <= params.event_recency_bars)
    level = c("last_event.level")
    return (
        Rule("TREND_CONTINUATION_LONG", "LONG", f"Uptrend structure pulled back toward the {f} EMA while holding above the {s}.", (
            ("trend is UPTREND", c("trend") == "UPTREND"),
            ("bias is BULLISH", c("bias") == "BULLISH"),
            (f"close pulled back to or below the {f} EMA", c("close") <= fast + 0.25 * c("atr")),
            (f"close still above the {s} EMA", c("close") > slow),
            ("RSI below 65 (not extended)", c("rsi") < 65),
        ), c("active_high"), c("active_low")),
        Rule("TREND_CONTINUATION_SHORT", "SHORT", f"Downtrend structure rallied back toward the {f} EMA while capped by the {s}.", (
            ("trend is DOWNTREND", c("trend") == "DOWNTREND"),
            ("bias is BEARISH", c("bias") == "BEARISH"),
            (f"close rallied to or above the {f} EMA", c("close") >= fast - 0.25 * c("atr")),
            (f"close still below the {s} EMA", c("close") < slow),
            ("RSI above 35 (not extended)", c("rsi") > 35),
        ), c("active_low"), c("active_high")),
        Rule("RANGE_FADE_LONG", "LONG", "Non-trending market trading down into an established support cluster.", (
            ("regime is RANGING", c("trend_regime") == "RANGING"),
            ("structure is RANGE or CONTRACTION", coiled),
            ("price is at a support level", F.abs(c("close") - support.price) <= near),
            ("support has 2+ touches", support.touches >= 2),
            ("RSI below 45", c("rsi") < 45),
        ), support.price, support.price - c("atr")),
        Rule("RANGE_FADE_SHORT", "SHORT", "Non-trending market trading up into an established resistance cluster.", (
            ("regime is RANGING", c("trend_regime") == "RANGING"),
            ("structure is RANGE or CONTRACTION", coiled),
            ("price is at a resistance level", F.abs(c("close") - resistance.price) <= near),
            ("resistance has 2+ touches", resistance.touches >= 2),
            ("RSI above 55", c("rsi") > 55),
        ), resistance.price, resistance.price + c("atr")),
        Rule("VOLATILITY_BREAKOUT_LONG", "LONG", "Upside structure break emerging from a low-volatility compression.", (
            ("volatility was LOW before the break", c("vol_regime") == "LOW"),
            ("structure was coiling (CONTRACTION or RANGE)", coiled),
            ("a bullish break occurred recently", recent("BOS_BULLISH", "CHOCH_BULLISH")),
            ("close is above the broken level", c("close") > level),
        ), level, c("active_low")),
        Rule("REVERSAL_LONG", "LONG", "First bullish change of character after a downtrend.", (
            ("a bullish CHoCH occurred recently", recent("CHOCH_BULLISH")),
            ("close holds above the broken level", c("close") > level),
            ("RSI has recovered above 45", c("rsi") > 45),
        ), level, c("active_low")),
        Rule("REVERSAL_SHORT", "SHORT", "First bearish change of character after an uptrend.", (
            ("a bearish CHoCH occurred recently", recent("CHOCH_BEARISH")),
            ("close holds below the broken level", c("close") < level),
            ("RSI has rolled below 55", c("rsi") < 55),
        ), level, c("active_high")),
    )


def setups(bars: DataFrame, params: EngineParams = EngineParams()) -> DataFrame:
    """Adds setups (rules with every condition met) and near_miss_setups (texts) to bars with levels.

    A condition on a missing value isn't met; without an ATR there are neither.
    """
    out = bars.withColumn("support", F.array_max(F.filter("levels", lambda x: x.side == "SUPPORT"))).withColumn("resistance", F.array_min(F.filter("levels", lambda x: x.side == "RESISTANCE")))
    digits = params.price_decimals
    evaluated = F.array(*[
        F.struct(
            F.lit(rule.name).alias("name"),
            F.lit(rule.direction).alias("direction"),
            F.lit(rule.description).alias("description"),
            F.array(*[F.struct(F.lit(text).alias("text"), F.coalesce(ok, F.lit(False)).alias("ok")) for text, ok in rule.conditions]).alias("tests"),
            F.round(rule.trigger, digits).alias("trigger_level"),
            F.round(rule.invalidation, digits).alias("invalidation_level"),
        )
        for rule in rules(params)
    ])
    out = out.withColumn("__rules", F.when(F.col("atr").isNotNull(), evaluated).otherwise(F.slice(evaluated, 1, 0)))
    complete = F.filter("__rules", lambda r: F.forall(r.tests, lambda t: t.ok))
    met = lambda r: F.size(F.filter(r.tests, lambda t: t.ok))
    near = F.filter("__rules", lambda r: (met(r) < F.size(r.tests)) & (met(r) / F.size(r.tests) >= NEAR_MISS))
    texts = lambda tests: F.transform(tests, lambda t: t.text)
    told = lambda r: F.concat(r["name"], F.lit(": "), met(r).cast("string"), F.lit("/"), F.size(r.tests).cast("string"), F.lit(" met, missing "), F.array_join(texts(F.filter(r.tests, lambda t: ~t.ok)), "; "))
    shown = lambda r: F.struct(r["name"].alias("name"), r.direction.alias("direction"), r.description.alias("description"), texts(r.tests).alias("conditions"), r.trigger_level.alias("trigger_level"), r.invalidation_level.alias("invalidation_level"))
    return out.withColumn("setups", F.transform(complete, shown)).withColumn("near_miss_setups", F.transform(near, told)).drop("__rules")
