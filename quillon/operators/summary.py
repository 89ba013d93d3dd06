"""Per-model summaries, quality, eligibility and the recommendation; corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import at_ranks, numbered

#: Weights of the quality score, gates and the tolerance of the pick.
WEIGHTS = {"schema_compliance_rate": 0.20, "grounded_rate": 0.25, "fact_agreement_rate": 0.20, "no_contradiction": 0.15, "consistency": 0.15, "first_attempt_rate": 0.05}
MIN_COMPLIANCE, MIN_GROUNDED, MAX_CONTRADICTIONS, MAX_P95 = 0.90, 0.80, 1.0, 120.0
TOLERANCE = 0.03
CONSISTENCY_FIELDS = ("higher_timeframe_bias", "market_structure", "market_state", "setup_type")


def _mean(flag: Column, where: Column) -> Column:
    """Share of true among the rows that have the flag; 0 without any."""
    return F.coalesce(F.avg(F.when(where, flag.cast("int"))), F.lit(0.0))


def consistency(rows: DataFrame) -> DataFrame:
    """model, consistency, confidence_spread over examples with two good runs at least.

    The share of agreeing pairs of runs comes from the counts of equal answers: a value that n_v of n
    runs give makes n_v(n_v - 1) of n(n - 1) ordered pairs. No runs are paired.
    """
    good = rows.filter("ok")
    by = ["model", "example_id"]
    sizes = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max("confidence") - F.min("confidence")).alias("spread")).filter("n >= 2")
    answers = good.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in CONSISTENCY_FIELDS])).alias("x")).select(*by, "x.field", "x.v")
    pairs = answers.groupBy(*by, "field", "v").agg(F.count(F.lit(1)).alias("m")).groupBy(*by).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("same"))
    per = sizes.join(pairs, by).withColumn("agree", F.col("same") / (len(CONSISTENCY_FIELDS) * F.col("n") * (F.col("n") - 1)))
    return per.groupBy("model").agg(F.avg("agree").alias("consistency"), F.avg("spread").alias("confidence_spread"))


def summarise(rows: DataFrame) -> DataFrame:
    """One row for each model, over first runs but for calls, total_cost and consistency."""
    first, ok = F.col("run") == 0, (F.col("run") == 0) & F.col("ok")
    mean = lambda c, where: F.avg(F.when(where, F.col(c)))
    nearest = lambda q: lambda n: F.least(n - 1, F.bround(F.lit(q) * (n - 1), 0).cast("long"))
    latency = at_ranks(rows.filter(first), F.coalesce("latency_seconds", F.lit(0.0)), ("model",), {"p50_latency": nearest(0.5), "p95_latency": nearest(0.95)})
    out = rows.groupBy("model").agg(
        F.count_if(first).alias("examples"),
        F.count(F.lit(1)).alias("calls"),
        _mean(F.col("ok"), first).alias("schema_compliance_rate"),
        _mean(F.col("first_attempt_ok"), first).alias("first_attempt_rate"),
        mean("attempts", first).alias("mean_attempts"),
        F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("agreement_points"))), F.sum(F.when(ok, F.col("agreement_comparable")))), F.lit(0.0)).alias("fact_agreement_rate"),
        _mean(F.col("structure_agrees"), ok).alias("structure_agreement_rate"),
        _mean(F.col("htf_bias_agrees"), ok).alias("htf_agreement_rate"),
        _mean(F.col("setup_agrees"), ok).alias("setup_agreement_rate"),
        _mean(F.col("is_grounded"), ok).alias("grounded_rate"),
        F.coalesce(mean("hallucinated_numbers", ok), F.lit(0.0)).alias("hallucinated_numbers_per_example"),
        F.coalesce(mean("numbers_in_prose", ok), F.lit(0.0)).alias("numbers_in_prose_per_example"),
        F.coalesce(mean("contradiction_count", ok), F.lit(0.0)).alias("contradictions_per_example"),
        F.coalesce(mean("confidence", ok), F.lit(0.0)).alias("mean_confidence"),
        mean("prompt_tokens", first).alias("mean_prompt_tokens"),
        mean("completion_tokens", first).alias("mean_completion_tokens"),
        mean("cost", first).alias("mean_cost"),
        F.sum("cost").alias("total_cost"),
    )
    out = out.withColumn("valid_json_rate", F.col("first_attempt_rate"))
    out = out.join(latency.withColumnRenamed("model", "__model"), F.col("model").eqNullSafe(F.col("__model")), "left").drop("__model")
    return out.join(consistency(rows), "model", "left")


def errors(rows: DataFrame) -> DataFrame:
    """model, label, n: errors of first runs by the text before the first colon."""
    label = F.substring(F.split("error", ":")[0], 1, 60)
    return rows.filter((F.col("run") == 0) & (F.col("error") != "")).groupBy("model", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def contradiction_counts(rows: DataFrame) -> DataFrame:
    """model, code, n over good first runs."""
    return rows.filter("run = 0 and ok").select("model", F.explode("contradictions").alias("code")).groupBy("model", "code").agg(F.count(F.lit(1)).alias("n"))


def quality(summaries: DataFrame) -> DataFrame:
    """Adds quality: the weighted score; unknown consistency counts half."""
    part = {c: F.col(c) for c in WEIGHTS if c != "no_contradiction"}
    part["no_contradiction"] = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("contradictions_per_example")))
    part["consistency"] = F.coalesce(F.nanvl("consistency", F.lit(0.5)), F.lit(0.5))
    return summaries.withColumn("quality", sum((part[c] * w for c, w in WEIGHTS.items()), F.lit(0.0)))


def gates(summaries: DataFrame) -> DataFrame:
    """Adds failed_gates (names, in order) and eligible."""
    tests = (
        ("schema_compliance", F.col("schema_compliance_rate") < MIN_COMPLIANCE),
        ("grounded", F.col("grounded_rate") < MIN_GROUNDED),
        ("contradictions", F.col("contradictions_per_example") > MAX_CONTRADICTIONS),
        ("latency", F.col("p95_latency") > MAX_P95),
    )
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return summaries.withColumn("failed_gates", failed).withColumn("eligible", F.size("failed_gates") == 0)


def recommend(candidates: DataFrame, dataset_size: int) -> DataFrame:
    """Adds projected_cost, quality_per_cost, rank and chosen: the cheapest eligible model whose quality is within
    TOLERANCE of the best eligible one; the best if none of them has a cost. candidates: one row for each model."""
    cost = F.col("mean_cost") * dataset_size / F.greatest("schema_compliance_rate", F.lit(1e-6))
    out = candidates.withColumn("projected_cost", cost).withColumn("quality_per_cost", F.try_divide(F.col("quality"), F.col("projected_cost")))
    every = Window.partitionBy()
    best = F.max(F.when(F.col("eligible"), F.col("quality"))).over(every)
    near = F.col("eligible") & (F.col("quality") >= best - TOLERANCE) & F.col("projected_cost").isNotNull()
    order = Window.orderBy(F.desc("eligible"), F.desc("quality"), "model")
    out = out.withColumn("rank", F.row_number().over(order)).withColumn("__near", near).withColumn("__any", F.max(near).over(every))
    pick = F.row_number().over(Window.orderBy(F.desc("__near"), F.when(F.col("__near"), F.col("projected_cost")), F.desc("quality"), "model"))
    return out.withColumn("chosen", F.col("eligible") & F.when(F.col("__any"), pick == 1).otherwise(F.col("rank") == 1)).drop("__near", "__any")


def corpus_counts(rows: DataFrame) -> DataFrame:
    """dimension, value, n of the accepted rows by split, stratum and interval, in one pass."""
    keys = ("split", "stratum", "interval")
    sets = rows.filter("accepted").groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "stratum").otherwise("interval")
    return sets.select(name.alias("dimension"), F.coalesce(*keys).alias("value"), "n")


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def corpus_totals(rows: DataFrame) -> DataFrame:
    """One row: generated, accepted, rate, symbols, the range of the accepted and how many prompt hashes they mix."""
    a = F.col("accepted")
    return rows.agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(a).alias("accepted"),
        F.coalesce(F.avg(a.cast("int")), F.lit(0.0)).alias("accept_rate"),
        F.countDistinct(F.when(a, F.col("symbol"))).alias("symbols"),
        F.min(F.when(a, F.col("as_of"))).alias("first_as_of"),
        F.max(F.when(a, F.col("as_of"))).alias("last_as_of"),
        F.countDistinct(F.when(a, F.col("prompt_hash"))).alias("prompt_hashes"),
    )


def pending(jobs: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("model", "example_id", "run")) -> DataFrame:
    """Jobs without a checkpointed row: resuming is an anti-join."""
    return jobs.join(done.select(*keys), list(keys), "left_anti")


def jobs(examples: DataFrame, models: list[str], repeats: int = 1) -> DataFrame:
    """Every example for every model and run: the models and runs are constants of the plan, so no join is needed."""
    return examples.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def strided(examples: DataFrame, count: int, order: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """``count`` examples at positions floor(i n / count) of the order; all, if there are no more.

    A row is taken if some i falls on it, which arithmetic on its own position tells.
    """
    n = examples.count()
    if n <= count:
        return examples
    first = F.ceil(F.col("__at") * count / n)
    return numbered(examples, n, order).select(*examples.columns, "__at").filter((F.floor(first * n / count) == F.col("__at")) & (first < count)).drop("__at")
