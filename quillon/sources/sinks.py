"""Where results go: immutable raw files, reports, records, summaries, the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.scalar import SERIES
from .csv import safe_stem

#: The benchmark table's columns, in order.
SUMMARY_COLUMNS = (
    "model", "examples", "calls", "valid_json_rate", "schema_compliance_rate", "first_attempt_rate", "mean_attempts", "fact_agreement_rate", "structure_agreement_rate", "htf_agreement_rate", "setup_agreement_rate",
    "grounded_rate", "hallucinated_numbers_per_example", "numbers_in_prose_per_example", "contradictions_per_example", "consistency", "confidence_spread", "mean_confidence", "p50_latency", "p95_latency",
    "mean_prompt_tokens", "mean_completion_tokens", "mean_cost", "total_cost",
)


def write_raw(bars: DataFrame, path: str) -> None:
    """Raw candles as CSV; what is there already is never overwritten."""
    bars.write.mode("errorifexists").option("header", True).csv(path)


def write_series(bars: DataFrame, path: str) -> None:
    """Raw candles as CSV, one file for each series, in folders by symbol and interval and in the order of pos."""
    bars.repartition(*SERIES).sortWithinPartitions(*SERIES, "pos").drop("pos").write.mode("errorifexists").partitionBy(*SERIES).option("header", True).csv(path)


def write_lineage(records: DataFrame, path: str) -> None:
    """The record of each series as a JSON file of its own; what is there already is never overwritten."""
    rows = records.select(safe_stem(F.col("symbol"), F.col("interval")).alias("of"), F.to_json(F.struct(*records.columns)).alias("value"))
    rows.repartition("of").write.mode("errorifexists").partitionBy("of").text(path)


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_corpus(judged: DataFrame, accepted: str, rejected: str) -> None:
    """Accepted and rejected rows apart; what judged them runs once."""
    rows = judged.persist()
    try:
        rows.filter("accepted").write.json(accepted)
        rows.filter("not accepted").write.json(rejected)
    finally:
        rows.unpersist()


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs by view and split."""
    pairs.write.partitionBy("view", "split").json(path)


def write_summary(summaries: DataFrame, path: str) -> None:
    """The benchmark table: fixed columns, six decimals; one row for each model, so one file."""
    kinds = dict(summaries.dtypes)
    summaries.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in SUMMARY_COLUMNS]).orderBy("model").coalesce(1).write.option("header", True).csv(path)


def write_screen(screened: DataFrame, path: str) -> None:
    """The screen as CSV, best first; one row for each series, so one file."""
    screened.orderBy(F.desc("score")).coalesce(1).write.option("header", True).csv(path)


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON report for each series: verdict, dataset, the ten checks and the issues."""
    return reports.select(*SERIES, F.to_json(F.struct(*reports.columns)).alias("report"))


def _table(header: str, rows: list[tuple]) -> list[str]:
    return [f"| {header.replace(',', ' |')} |", "|-" * (header.count(",") + 1) + "|", *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), ""]


def report_markdown(report: dict) -> str:
    """A report for people, of one series."""
    issues, shown = report["issues"], lambda i, c: ", ".join(str(x[c]) for x in i.get("samples") or () if x.get(c) is not None)
    lines = [f"# {report['symbol']} {report['interval']}: {report['verdict']}", "", f"{report['errors']} errors, {report['warnings']} warnings. Nothing was changed or repaired.", "", "## Dataset", ""]
    lines += _table("fact,value", [(k, ", ".join(v) if isinstance(v, list) else "-" if v is None else v) for k, v in report["dataset"].items()])
    lines += ["## Checks", "", *_table("check,result,errors,warnings", [(c["check"], "PASS" if c["passed"] else "FAIL", c["errors"], c["warnings"]) for c in report["checks"]])]
    if issues:
        rows = sorted(issues, key=lambda i: (i["severity"], i["check"], i["code"], i["field"] or ""))
        lines += ["## Findings", "", *_table("check,code,field,severity,count,first rows,first times", [(i["check"], i["code"], i["field"] or "", i["severity"], i["count"], shown(i, "pos"), shown(i, "ts")) for i in rows])]
    return "\n".join(lines).rstrip("\n") + "\n"


def recommendation_markdown(ranked: list[dict]) -> str:
    """The recommendation for people, best first."""
    chosen = next((r["model"] for r in ranked if r["chosen"]), None)
    lines = [f"# Recommendation: {chosen or 'no eligible model'}", "", "| rank | model | quality | projected cost | why not |", "|-|-|-|-|-|"]
    lines += [f"| {r['rank']} | {r['model']} | {r['quality']:.3f} | {'-' if r['projected_cost'] is None else format(r['projected_cost'], '.2f')} | {', '.join(r['failed_gates']) or '-'} |" for r in sorted(ranked, key=lambda r: r["rank"])]
    return "\n".join(lines) + "\n"


def data_dictionary(schema: StructType, comments: dict[str, str] | None = None) -> str:
    """Every field of a schema, nested ones by dotted path, as a Markdown table."""
    comments, rows = comments or {}, []

    def walk(kind: DataType, at: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                path = f"{at}.{f.name}" if at else f.name
                rows.append((path, f.dataType.simpleString() if not isinstance(f.dataType, (StructType, ArrayType)) else f.dataType.typeName(), f.nullable, f.metadata.get("comment") or comments.get(path, "")))
                walk(f.dataType, path)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{at}[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, f"{at}.*")

    walk(schema, "")
    return "\n".join(["| field | type | optional | description |", "|-|-|-|-|", *(f"| {p} | {t} | {'yes' if n else 'no'} | {c} |" for p, t, n, c in rows)]) + "\n"
