"""Command line: validate, screen, context, summary, schema, sample, report, regate, describe, export."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators import context, indicators, metrics, sampler, screen, structure, summary, teacher, validate, views
from .params import EngineParams, Thresholds, load_sectors, load_yaml
from .session import session
from .sources import csv, records, sinks, tables


def _bars(spark, path: str):
    return csv.scan(spark, path).drop("file", *csv.FILE_FACTS)


def _gated(spark, args):
    bars = csv.scan(spark, args.path)
    judged = validate.verdicts(bars, validate.all_issues(bars))
    if not args.allow_failed and judged.filter("verdict = 'FAIL'").limit(1).count():
        sys.exit("a series fails validation; see validate, or pass --allow-failed")
    return bars.drop("file", *csv.FILE_FACTS)


def cmd_validate(spark, args) -> int:
    limits = load_yaml(args.config, Thresholds, "thresholds") if args.config else Thresholds()
    bars = csv.scan(spark, args.path)
    found = validate.all_issues(bars, limits, samples=validate.SAMPLES)
    reports = validate.reports(bars, found, csv.digests(spark, args.path)).persist()
    if args.out:
        sinks.write_records(sinks.report_json(reports), args.out)
    failed = 0
    # A few rows a series.
    for r in reports.orderBy("symbol", "interval").toLocalIterator():
        print(sinks.report_markdown(r.asDict(recursive=True)))
        failed += r["verdict"] == "FAIL"
    reports.unpersist()
    return 1 if failed else 0


def cmd_screen(spark, args) -> int:
    bars = indicators.indicators(tables.numbered(_bars(spark, args.path).filter(F.col("close").isNotNull()), "pos"))
    ranked = screen.buckets(screen.measure(bars), args.min_turnover)
    if args.candidates:
        ranked = screen.with_sectors(ranked, spark.createDataFrame(load_sectors(args.candidates), "symbol string, sector string"))
    if args.out:
        sinks.write_screen(ranked, args.out)
    ranked.filter("bucket = 'clean'").orderBy(F.desc("score")).show(args.top, truncate=False)
    return 0


def cmd_context(spark, args) -> int:
    params = load_yaml(args.config, EngineParams) if args.config else EngineParams()
    bars = _gated(spark, args)
    chosen = context.strided(bars, args.count, max(params.ema_periods)) if args.bar is None else context.at_bar(bars, args.bar)
    out = context.context_json(context.contexts(bars, chosen, params))
    if args.out:
        out.select("context").write.text(args.out)
    else:
        for r in out.orderBy("symbol", "pos").collect():
            print(r["context"])
    return 0


def cmd_summary(spark, args) -> int:
    rows = structure.structure(indicators.indicators(_gated(spark, args)))
    rows.groupBy("symbol", "trend", "vol_regime", "trend_regime").count().orderBy("symbol", "trend").show(200, truncate=False)
    return 0


def cmd_schema(spark, args) -> int:
    empty = spark.createDataFrame([], "symbol string, interval string, pos int, ts timestamp, open double, high double, low double, close double, volume double")
    schema = context.contexts(empty).schema["context"].dataType
    print(schema.json() if args.json else sinks.data_dictionary(schema))
    return 0


def cmd_sample(spark, args) -> int:
    """Frozen examples: the chosen bars with their contexts, as scoring, regating and exporting read them."""
    params = load_yaml(args.config, EngineParams) if args.config else EngineParams()
    spec = sampler.SampleSpec(target_count=args.count, cutoff=args.cutoff, min_separation=params.ohlcv_window_bars)
    scanned = csv.scan(spark, args.path)
    bars = _gated(spark, args)
    chosen = sampler.choose(sampler.candidates(structure.structure(indicators.indicators(bars, params), params), spec), spec)
    if args.out:
        sinks.write_records(sampler.examples(chosen, context.contexts(bars, chosen, params), scanned), args.out)
    print(json.dumps([r.asDict() for r in sampler.describe(chosen).collect()]))
    return 0


def _scored(spark, path: str, context_schema: str | None = None):
    return records.read_checkpoint(spark, path, teacher.SCORED + (f", context {context_schema}" if context_schema else ""))


def _context_type(spark) -> str:
    empty = spark.createDataFrame([], "symbol string, interval string, pos int, ts timestamp, open double, high double, low double, close double, volume double")
    return context.contexts(empty).schema["context"].dataType.simpleString()


def _gate(args) -> metrics.GateSpec:
    return metrics.GateSpec(require_grounded=not args.allow_ungrounded, forbid_contradictions=not args.allow_contradictions, require_first_attempt=args.first_attempt)


def _summaries(spark, args):
    rows = _scored(spark, args.path)
    return summary.summarise(rows.select("*", *[F.col(f"analysis.{c}") for c in (*summary.CONSISTENCY_FIELDS, "confidence")]))


def cmd_report(spark, args) -> int:
    """Model summaries, and the recommendation for a corpus of --count rows."""
    summaries = _summaries(spark, args)
    if args.out:
        sinks.write_summary(summaries, args.out)
    ranked = summary.recommend(summary.gates(summary.quality(summaries)), args.count)
    print(sinks.recommendation_markdown([r.asDict() for r in ranked.orderBy("rank").collect()]))
    return 0


def cmd_regate(spark, args) -> int:
    """Judges scored rows anew and writes what is accepted and what isn't."""
    rows = _scored(spark, args.path, _context_type(spark))
    judged = metrics.judge(rows, _gate(args)).withColumn("split", metrics.split(F.col("as_of"), args.val_start))
    sinks.write_corpus(judged, f"{args.out}/accepted", f"{args.out}/rejected")
    print(json.dumps(summary.corpus_totals(judged).first().asDict()))
    return 0


def cmd_describe(spark, args) -> int:
    """Totals, counts and reject reasons of scored rows."""
    judged = metrics.judge(_scored(spark, args.path), _gate(args)).withColumn("split", metrics.split(F.col("as_of"), args.val_start))
    totals = summary.corpus_totals(judged).first().asDict()
    print(json.dumps(totals | {"counts": [r.asDict() for r in summary.corpus_counts(judged).orderBy("dimension", "value").collect()], "rejects": {r["reason"]: r["n"] for r in summary.reject_counts(judged).collect()}}))
    if totals["prompt_hashes"] > 1:
        print(f"warning: the corpus mixes {totals['prompt_hashes']} prompts", file=sys.stderr)
    return 0


def cmd_export(spark, args) -> int:
    """Training pairs of the accepted rows in every view, by view and split."""
    prompt = records.load_prompt(args.prompts, args.prompt_version)
    rows = _scored(spark, args.path, _context_type(spark))
    judged = metrics.judge(rows, _gate(args)).withColumn("split", metrics.split(F.col("as_of"), args.val_start))
    pairs = None
    for view in views.VIEWS:
        own = teacher.pairs(judged, view, prompt["system"], prompt["user"])
        pairs = own if pairs is None else pairs.unionByName(own)
    sinks.write_pairs(pairs, args.out)
    for r in views.length_stats(spark.read.json(args.out), "tokens", "view").orderBy("view").collect():
        print(json.dumps(r.asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("validate", cmd_validate), ("screen", cmd_screen), ("context", cmd_context), ("summary", cmd_summary), ("schema", cmd_schema), ("sample", cmd_sample), ("report", cmd_report), ("regate", cmd_regate), ("describe", cmd_describe), ("export", cmd_export)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if name != "schema":
            p.add_argument("path")
            p.add_argument("--out")
        p.add_argument("--config")
        p.add_argument("--candidates")
        p.add_argument("--allow-failed", action="store_true")
        p.add_argument("--count", type=int, default=200 if name == "sample" else 20)
        p.add_argument("--bar", type=int)
        p.add_argument("--cutoff", default="2025-01-01")
        p.add_argument("--min-turnover", type=float, default=100.0)
        p.add_argument("--top", type=int, default=50)
        p.add_argument("--json", action="store_true")
        p.add_argument("--val-start", default="2024-01-01")
        p.add_argument("--allow-ungrounded", action="store_true")
        p.add_argument("--allow-contradictions", action="store_true")
        p.add_argument("--first-attempt", action="store_true")
        p.add_argument("--prompts", default="prompts")
        p.add_argument("--prompt-version", default="v1")
    args = parser.parse_args(argv)
    return args.run(session(), args)


if __name__ == "__main__":
    sys.exit(main())
