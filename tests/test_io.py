"""Sources, sinks, parsing, grounding details, streaming and the command line."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.operators import grounding, metrics, summary, teacher, validate, views
from quillon.operators.context import contexts
from quillon.operators.indicators import seeded
from quillon.plans import corpus
from quillon.sources import csv, records, sinks
from quillon.streaming.bars import stream_bars, stream_ema
from tests.conftest import TESTDATA
from tests.test_engine import clean_daily

HEAD = "datetime,open,high,low,close,volume\n"


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "\n".join(lines) + "\n")


def test_scan_reports_and_never_repairs(spark, tmp_path):
    folder = tmp_path / "raw"
    write(folder, "AAA_1d.csv", ["2024-01-02T00:00:00+00:00,1,2,0.5,1.5,10", "2024-01-01T00:00:00+00:00,x,2,0.5,1.5,10", "nonsense,1,2,0.5,nan,"])
    write(folder, "B_B_1h.csv", ["2024-01-01 00:00:00,1,2,0.5,1.5,10"])
    write(folder, "C_1d.csv", ["2024-01-01T00:00:00+05:30,1,2,0.5,1.5,10", "2024-01-02T00:00:00Z,1,2,0.5,1.5,10"])
    rows = csv.scan(spark, str(folder))
    a = rows.filter("symbol = 'AAA'").orderBy("pos").collect()
    assert [r["pos"] for r in a] == [0, 1, 2] and a[0]["ts"] == dt.datetime(2024, 1, 2) and a[1]["open"] is None and a[2]["ts"] is None and a[2]["close"] is None
    assert {(r["symbol"], r["interval"]) for r in rows.collect()} == {("AAA", "1d"), ("B_B", "1h"), ("C", "1d")}
    assert rows.filter("symbol = 'C' AND pos = 0").first()["ts"] == dt.datetime(2023, 12, 31, 18, 30)
    zones = {r["symbol"]: (r["original_tz"], r["mixed"]) for r in csv.timezones(rows).collect()}
    assert zones["B_B"] == (None, False) and zones["C"] == ("MIXED", True)
    import hashlib

    digest = {r["file"].split("/")[-1]: r["sha256"] for r in csv.digests(spark, str(folder)).collect()}
    assert digest["C_1d.csv"] == hashlib.sha256((folder / "C_1d.csv").read_bytes()).hexdigest()


@pytest.mark.parametrize("small", [True, False])
def test_scan_by_ranges_of_bytes(spark, tmp_path, monkeypatch, small):
    """Positions are the file's order, records go over lines and borders of ranges, and a quote that never closes joins nothing."""
    import csv as plain_csv
    import io

    folder = tmp_path / "raw"
    folder.mkdir()
    head = "note," + HEAD
    line = lambda i, note="": f'{note},2024-01-01T00:00:00+00:00,{i},2,0.5,1.5,10'
    notes = {7: '"two\nlines"', 40: '"a ""b"", and\n\nthen\nc"', 41: '"x\ny"', 200: '"' + "far\n" * 30 + '"'}
    files = {
        "PLAIN_1d.csv": "\n" + head + "".join(line(i) + "\n\n" * (i % 5 == 0) + "\n" for i in range(300)),
        "BREAKS_1d.csv": head + "".join(line(i, notes.get(i, "")) + "\n" for i in range(400)),
        "OPEN_1d.csv": head + "".join(line(i, '5"' if i == 9 else "") + "\n" for i in range(50)),
        "LONG_1d.csv": head + "".join(line(i, '"' if i in (3, 40) else "") + "\n" for i in range(60)),
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    monkeypatch.setattr(csv, "RECORD_LINES", 33)
    monkeypatch.setattr(csv, "RANGE_LINES", 64)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700" if small else "128MB")
    try:
        got = {r["symbol"]: r["rows"] for r in csv.scan(spark, str(folder)).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("pos", "open"))).alias("rows")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for symbol in ("PLAIN", "BREAKS"):
        expected = [float(r[2]) for r in list(filter(None, plain_csv.reader(io.StringIO(files[f"{symbol}_1d.csv"]))))[1:]]
        assert [tuple(r) for r in got[symbol]] == list(enumerate(expected))
    assert [r["pos"] for r in got["OPEN"]] == list(range(50)) and [r["open"] for r in got["OPEN"] if r["pos"] != 9] == [i for i in range(50) if i != 9]
    assert [r["pos"] for r in got["LONG"]] == list(range(60)) and sum(r["open"] is None for r in got["LONG"]) <= 2


def test_scan_of_files_without_rows(spark, tmp_path):
    folder = tmp_path / "raw"
    write(folder, "A_1d.csv", [])
    (folder / "B_1d.csv").write_text("")
    assert csv.scan(spark, str(folder)).count() == 0


def test_names(spark):
    row = spark.range(1).select(csv.safe_stem(F.lit("^NSE.X=F&G"), F.lit("1d")).alias("s"), csv.symbol_of(F.lit("plain")).alias("p"), csv.interval_of(F.lit("plain")).alias("i")).first()
    assert tuple(row) == ("IDX_NSE_X_F_G_1d", "plain", "1d")


def test_lineage(spark, tmp_path):
    (tmp_path / "A_1d.json").write_text(json.dumps({"symbol": "A", "interval": "1d", "rows": 3}, indent=1))
    (tmp_path / "B_1d.json").write_text("{broken")
    got = csv.lineage(spark, f"{tmp_path}/*.json").collect()
    assert [(r["stem"], r["interval"]) for r in got] == [("A_1d", "1d")]


def test_vendor_frames(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 0.5, 1.5, 9.0, 1.5)], ["Date", "Open", "High", "Low", "Close", "Volume", "Adj Close"])
    assert csv.normalise_vendor(df).columns == list(csv.COLUMNS)
    with pytest.raises(ValueError):
        csv.normalise_vendor(df.drop("Volume"))


def test_checkpoints_skip_broken_lines(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "k string, v int"
    records.append_checkpoint(spark.createDataFrame([("a", 1)], schema), path)
    records.append_checkpoint(spark.createDataFrame([("b", 2)], schema), path)
    (tmp_path / "c" / "part-cut.json").write_text('{"k": "c", "v": 3}\n{"k": "d", "v')
    assert {r["k"] for r in records.read_checkpoint(spark, path, schema).collect()} == {"a", "b", "c"}
    jobs = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    assert {r["k"] for r in summary.pending(jobs, records.read_checkpoint(spark, path, schema), ("k",)).collect()} == {"d"}


def test_prompts(tmp_path):
    (tmp_path / "v1").mkdir()
    for part in ("system", "user", "repair"):
        (tmp_path / "v1" / f"{part}.md").write_text(part)
    prompt = records.load_prompt(str(tmp_path), "v1")
    assert prompt["user"] == "user" and len(records.prompt_hash(prompt)) == 16


def test_raw_files_are_immutable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_raw(df, str(tmp_path / "raw"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_raw(df, str(tmp_path / "raw"))


def test_series_files_keep_names_and_order(spark, tmp_path):
    """Any symbol comes back from its folder, digits as text; rows keep the order of pos, which needn't be that of time."""
    symbols = ["A=B/C+D 5%", "007", "^N\u00e4me_x", "null"]
    rows = [(s, "1h", i, f"2024-01-01T{9 - i:02d}:00:00", 1.5 + i, None if i == 1 else 2.0, 1.0, 1e-9, 3.0) for s in symbols for i in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, pos int, datetime string, open double, high double, low double, close double, volume double")
    path = str(tmp_path / "series")
    sinks.write_series(bars.repartition(7), path)
    got = csv.scan(spark, path)
    shown = got.select("symbol", "interval", F.col("pos").cast("int"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "open", "high", "low", "close", "volume")
    assert sorted(map(tuple, shown.collect()), key=lambda r: (r[0], r[2])) == sorted(rows, key=lambda r: (r[0], r[2]))
    assert got.select("file").distinct().count() == len(symbols)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_series(bars, path)


def test_data_dictionary():
    from pyspark.sql.types import StructType

    text = sinks.data_dictionary(StructType.fromDDL("a struct<b:array<struct<c:int>>,m:map<string,double>>"), {"a.b[].c": "a count"})
    assert "| a.b[].c | int | yes | a count |" in text and "a.m" in text


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('thinking {not json} then {"a": {"b": "}"}} done', '{"a": {"b": "}"}}'),
        ('{"first": 1} and {"last": "a \\" { b"}', '{"last": "a \\" { b"}'),
        ("no object", None),
        (None, None),
    ],
)
def test_extract_object(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string").select(views.extract_object(F.col("t")).alias("o"))
    assert df.first()["o"] == expected


TREE = {"a": {"b": [{"id": "S0", "v": 1.5}, {"t": "2024", "v": 2}]}, "ema": {"20": 3.0}, "x": {"only": None}}


@pytest.mark.parametrize(("path", "expected"), [("a.b[0].v", [1.5]), ("a.b[-1].v", [2]), ("a.b[s0].v", [1.5]), ("a.b.2024.v", [2]), ("a.b[5].v", []), ("x.only", [None]), ("nope", []), ("a.b[0].v.w", []), (" a . b [ 0 ] . v ", [1.5])])
def test_paths(path, expected):
    assert grounding.Document(TREE).at(path) == expected


def test_paths_completed():
    tree = TREE | {"deep": {"ema": {"20": 4.0, "50": 1.0}, "b": [[{"v": 9}]]}}
    document = grounding.Document(tree)
    assert document.completed("ema.50") == "deep.ema.50" and document.completed("b[1].v") == "a.b[1].v" and document.completed("[0].v") is None
    assert document.completed("20") is None  # two fields end so
    assert document.cited("ema.50") == {"found": True, "kind": "number", "text": "1.0", "number": 1.0, "concession": "deep.ema.50"}
    assert document.cited("b[0]") == {"found": False, "kind": None, "text": None, "number": None, "concession": None}  # a.b[0] and deep.b[0]
    assert document.cited("only")["found"] and document.cited("a.b")["kind"] == "filled" and not document.cited("")["found"] and not document.cited(None)["found"]
    assert document.numbers == {1.5, 2.0, 3.0, 4.0, 1.0, 9.0} and document.periods == {"20", "50"}


def test_prose_numbers(spark):
    count = lambda text, *p: spark.range(1).select(grounding.numbers_in_prose(F.lit(text), F.array(*[F.lit(x) for x in p]).cast("array<string>")).alias("n")).first()["n"]
    assert count("RSI14 at 452.10 and 1,234") == 2
    assert count("the 200-day EMA", "200") == 0 and count("the 200-day EMA") == 1 and count("EMA 200 near 200", "200") == 1


def test_gate_spec(spark):
    rows = spark.createDataFrame([(True, 1, 0, 2, 1, False), (False, 1, 1, 1, 1, True), (True, 0, 0, 0, 0, False)], "ok boolean, hallucinated_numbers int, unresolvable_fields int, numbers_in_prose int, contradiction_count int, first_attempt_ok boolean")
    reasons = lambda spec: [r["reasons"] for r in metrics.judge(rows, spec).collect()]
    assert reasons(metrics.GateSpec()) == [["UNGROUNDED_NUMBER", "NUMBER_IN_PROSE", "CONTRADICTION"], ["CALL_FAILED"], []]
    assert reasons(metrics.GateSpec(False, False, True)) == [["NEEDED_REPAIR"], ["CALL_FAILED"], ["NEEDED_REPAIR"]]


def test_parse_and_shape(spark):
    good = {
        "higher_timeframe_bias": "NEUTRAL", "market_structure": "RANGE", "market_state": "RANGING", "setup_type": "NONE", "confidence": 0.4,
        "supporting_evidence": [{"statement": "s", "context_field": "f", "value": "v"}] * 2, "conflicting_evidence": [{"statement": "s", "context_field": "f", "value": "v"}],
        "important_levels": [{"price": 1.0, "role": "SUPPORT", "context_field": "f", "note": "n"}], "scenarios": [{"direction": "BULLISH"}, {"direction": "BEARISH"}],
    }
    bad = good | {"confidence": 1.4, "market_state": "UP", "scenarios": [{"direction": "SIDEWAYS"}], "important_levels": []}
    texts = [json.dumps(good), f"thinking {{...}} so: {json.dumps(good)} ok", json.dumps(bad), "none", None]
    got = teacher.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False]
    assert [e.split(":")[0] for e in got[2]["errors"]] == ["important_levels", "scenarios", "market_state", "scenarios.direction", "confidence"]
    assert got[0]["analysis"]["confidence"] == 0.4 and got[2]["analysis"] is None


def test_json_schemas():
    from pyspark.sql.types import StructType

    from quillon.functions import jsonschema

    made = jsonschema.of_type(StructType.fromDDL("a string, b array<struct<c:int>>"), {"a": ("X", "Y")})
    assert made["required"] == ["a", "b"] and made["properties"]["a"]["enum"] == ["X", "Y"] and made["properties"]["b"]["items"]["additionalProperties"] is False
    loose = {"properties": {"v": {"$ref": "#/$defs/V", "description": "own"}, "pattern": {"type": "string", "pattern": "x"}, "own": {"type": "integer"}}, "$defs": {"V": {"type": "object", "properties": {"n": {"type": "number", "minimum": 0}}, "description": "other"}}}
    tight = jsonschema.strict(loose, frozenset({"own"}))
    assert tight["required"] == ["v", "pattern"] and tight["properties"]["pattern"] == {"type": "string"} and "$defs" not in tight
    assert tight["properties"]["v"] == {"type": "object", "properties": {"n": {"type": "number"}}, "description": "own", "additionalProperties": False, "required": ["n"]}
    assert jsonschema.outline(tight).splitlines()[:2] == ["- v (object): own", "  - n (number)"]
    with pytest.raises(ValueError):
        jsonschema.strict({"properties": {"x": {"$ref": "#/$defs/X"}}, "$defs": {"X": {"properties": {"x": {"$ref": "#/$defs/X"}}}}})


def test_stream_bars_and_ema(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, event_id bigint"
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(minutes=7 * i), 100.0 + (i * 37 % 11), i) for i in range(200)]
    for part in range(2):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        stream = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.table(name)

    got = {r["ts"]: r["close"] for r in run(stream_bars(events), "bars_stream", "append").collect()}
    batch = spark.createDataFrame(rows, schema).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.max_by("price", "ts").alias("close"))
    expected = {r["h"]: r["close"] for r in batch.collect()}
    assert len(got) > 15 and all(expected[t] == c for t, c in got.items())
    ema = {r["n"]: r["ema"] for r in run(stream_ema(events.select("symbol", "ts", F.col("price").alias("close")), 5), "ema_stream", "append").collect()}
    whole = seeded(pd.Series([r[2] for r in rows]).to_numpy(), 5, 2 / 6)
    assert len(ema) == 200


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows = clean_daily(80)
    write(tmp_path / "raw", "CLEAN_1d.csv", [",".join([r[3].isoformat() + "+00:00", *map(str, r[4:])]) for r in rows])
    assert cli.main(["validate", str(tmp_path / "raw")]) == 0
    assert "PASS" in capsys.readouterr().out
    assert cli.main(["context", str(tmp_path / "raw"), "--bar", "70"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["bar_index"] == 70
    assert cli.main(["context", str(tmp_path / "raw"), "--bar", "-1"]) == 0
    assert cli.main(["schema"]) == 0
    assert "ohlcv_window" in capsys.readouterr().out
    rows[3][5] = rows[3][6] - 1
    write(tmp_path / "bad", "CLEAN_1d.csv", [",".join([r[3].isoformat() + "+00:00", *map(str, r[4:])]) for r in rows])
    assert cli.main(["validate", str(tmp_path / "bad")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["context", str(tmp_path / "bad")])


def test_corpus_commands(spark, tmp_path, capsys, monkeypatch):
    """Answers to scored rows, then report, regate, describe and export over the kept rows."""
    from quillon.operators.context import contexts
    from tests.test_engine import FAST, frame

    monkeypatch.setattr(cli, "session", lambda: spark)
    seen = contexts(frame(spark, clean_daily(100)), params=FAST).filter("pos >= 60")
    rows = seen.select(F.concat("symbol", F.lit("#"), "pos").alias("example_id"), "symbol", "interval", "pos", "context")
    x = F.col("context")
    evidence = lambda f, v: F.struct(F.lit("as shown").alias("statement"), F.lit(f).alias("context_field"), v.cast("string").alias("value"))
    answer = F.to_json(F.struct(
        F.coalesce(x.higher_timeframe.bias, F.lit("UNAVAILABLE")).alias("higher_timeframe_bias"),
        x.structure.trend.alias("market_structure"),
        F.lit("RANGING").alias("market_state"),
        F.coalesce(F.get(F.transform(x.setups, lambda s: s["name"]), F.lit(0)), F.lit("NONE")).alias("setup_type"),
        F.array(evidence("structure.trend", x.structure.trend), evidence("indicators.rsi", x.indicators.rsi)).alias("supporting_evidence"),
        F.array(evidence("volatility.regime", x.volatility.regime)).alias("conflicting_evidence"),
        F.array(F.struct(F.element_at(x.ohlcv_window, -1).c.alias("price"), F.lit("TRIGGER").alias("role"), F.when(F.col("pos") % 2 == 0, "ohlcv_window[-1].c").alias("context_field"))).alias("important_levels"),
        F.array(F.struct(F.lit("BULLISH").alias("direction")), F.struct(F.lit("BEARISH").alias("direction"))).alias("scenarios"),
        F.lit(0.5).alias("confidence"),
    ))
    answers = rows.select("example_id", F.when(F.col("pos") % 10 == 3, "no answer").otherwise(answer).alias("text"))
    scored = teacher.score(teacher.parse(answers), rows.select("example_id", "symbol", "interval", "context"))
    scored = scored.select("*", F.lit("m").alias("model"), F.lit(0).alias("run"), F.lit("s").alias("stratum"), F.col("context.as_of").alias("as_of"), F.lit(1).alias("attempts"), F.col("ok").alias("first_attempt_ok"), F.lit(2.0).alias("latency_seconds"), F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), F.lit(0.1).alias("cost"), F.lit("h").alias("prompt_hash"))
    kept = str(tmp_path / "scored")
    records.append_checkpoint(scored.drop("errors", "text"), kept)

    assert cli.main(["report", kept, "--count", "100", "--out", str(tmp_path / "summary")]) == 0
    out = capsys.readouterr().out
    assert "# Recommendation: m" in out and "11.11" in out
    assert cli.main(["describe", kept, "--val-start", "2024-04-15"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["generated"], told["accepted"], told["rejects"]) == (40, 36, {"CALL_FAILED": 4})
    assert {c["value"] for c in told["counts"] if c["dimension"] == "split"} == {"train", "val"}
    assert cli.main(["regate", kept, "--out", str(tmp_path / "corpus"), "--first-attempt"]) == 0
    assert spark.read.json(str(tmp_path / "corpus" / "rejected")).count() == 4
    (tmp_path / "prompts" / "v1").mkdir(parents=True)
    for part in ("system", "user", "repair"):
        (tmp_path / "prompts" / "v1" / f"{part}.md").write_text("Context: {context}")
    capsys.readouterr()
    assert cli.main(["export", kept, "--out", str(tmp_path / "pairs"), "--prompts", str(tmp_path / "prompts")]) == 0
    pairs = {json.loads(line)["view"]: json.loads(line)["pairs"] for line in capsys.readouterr().out.strip().splitlines()}
    assert pairs == {"full": 36, "tail": 36, "compact": 16}
    told = spark.read.json(str(tmp_path / "pairs")).select("lineage.*").distinct().collect()
    assert {(r["teacher_model"], r["engine_version"], r["params_fingerprint"]) for r in told} == {(r["teacher_model"], "1.0.0", FAST.fingerprint()) for r in told} and all(r["teacher_model"] for r in told)


def test_views_of_full_windows(spark):
    """Citations of candles within and beyond the last 20, by brute force; and the registered queries see 60 candles."""
    bars = spark.createDataFrame(clean_daily(90), "symbol string, interval string, pos int, ts timestamp, open double, high double, low double, close double, volume double")
    back = (1, 20, 21, 60, 61)
    cite = F.concat(F.lit("ohlcv_window[-"), F.get(F.array(*map(F.lit, back)), F.col("pos") % len(back)).cast("string"), F.lit("].c"))
    none = F.array().cast("array<struct<context_field:string>>")
    analysis = F.struct(F.array(F.struct(cite.alias("context_field"))).alias("supporting_evidence"), none.alias("conflicting_evidence"), none.alias("important_levels"))
    rows = contexts(bars).withColumn("analysis", analysis).persist()
    for name, kept in (("full", 60), ("tail", 20), ("compact", 0)):
        got = {r["pos"] for r in views.view(rows, name).select("pos").collect()}
        assert got == {p for p in range(90) if back[p % len(back)] <= min(p + 1, kept)}, name
    rows.unpersist()
    sizes = corpus.cited(spark, f"{TESTDATA}/sf0.001").agg(F.max(F.size("context.ohlcv_window"))).first()[0]
    assert sizes == 60


def test_files_lack_and_add_columns(spark, tmp_path, capsys, monkeypatch):
    """Columns go by each file's own header; what is absent, added or unreadable is reported, with the first rows of row findings."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "NOVOL_1d.csv").write_text("\ufeffClose,datetime,Open,High,Low\n" + "".join(f'"{c}",2024-01-{d:02d}T00:00:00Z,{c},{c + 1},{c - 1}\n' for d, c in enumerate(range(10, 22), 1)))
    (folder / "EXTRA_1d.csv").write_text("datetime,open,high,low,close,volume,note\n\n2024-01-01T00:00:00Z,1,2,0.5,1.5,10,\"a, \"\"b\"\"\"\n2024-01-02T00:00:00Z,1,2,0.5,,10\n")
    (folder / "TEXT_1d.csv").write_text("datetime,open,high,low,close,volume\nsoon,one,2,0.5,1.5,10\nlater,two,2,0.5,1.5,10\n")
    (folder / "MIXED_1d.csv").write_text(HEAD + "2024-01-01T00:00:00Z,1,2,0.5,1.5,10\n2024-01-02T00:00:00+05:30,1,2,0.5,1.5,10\n")
    rows = csv.scan(spark, str(folder))
    a = rows.filter("symbol = 'NOVOL'").orderBy("pos").first()
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["pos"]) == (10.0, 11.0, 9.0, 10.0, None, 0)
    assert rows.filter("symbol = 'EXTRA'").count() == 2
    found = {(r["symbol"], r["code"], r["field"]): r for r in validate.all_issues(rows, samples=10).collect()}
    assert found["NOVOL", "MISSING_COLUMN", "volume"]["severity"] == "ERROR" and ("NOVOL", "NULL_VALUE", "volume") not in found
    assert found["EXTRA", "EXTRA_COLUMN", "note"]["severity"] == "INFO" and [s["pos"] for s in found["EXTRA", "NULL_VALUE", "close"]["samples"]] == [1]
    assert {("TEXT", "DATETIME_UNPARSEABLE", "datetime"), ("TEXT", "NON_NUMERIC_COLUMN", "open"), ("MIXED", "MIXED_TIMEZONE", None)} <= set(found)
    verdict = {r["symbol"]: r["verdict"] for r in validate.verdicts(rows, validate.all_issues(rows)).collect()}
    assert verdict == {"NOVOL": "FAIL", "EXTRA": "FAIL", "TEXT": "FAIL", "MIXED": "FAIL"}
    assert cli.main(["validate", str(folder)]) == 1
    out = capsys.readouterr().out
    assert "| required_columns | MISSING_COLUMN | volume | ERROR | 1 |" in out and "| missing_values | NULL_VALUE | close | ERROR | 1 | 1 |" in out
    with pytest.raises(SystemExit):
        cli.main(["context", str(folder)])


def test_frames_of_wrong_columns(spark):
    bars = spark.createDataFrame([("A", "1d", i, dt.datetime(2024, 1, 1 + i), "1.0", 2.0, 0.5, 1.0, "x") for i in range(12)], "symbol string, interval string, pos int, ts timestamp, open string, high double, low double, close double, note string")
    found = {(r["code"], r["field"]) for r in validate.all_issues(bars).collect()}
    assert {("MISSING_COLUMN", "volume"), ("EXTRA_COLUMN", "note")} <= found


def test_the_last_answer_of_the_right_shape(spark):
    good = {
        "higher_timeframe_bias": "NEUTRAL", "market_structure": "RANGE", "market_state": "RANGING", "setup_type": "NONE", "confidence": 0.4,
        "supporting_evidence": [{"statement": "s", "context_field": "f", "value": "v"}] * 2, "conflicting_evidence": [{"statement": "s", "context_field": "f", "value": "v"}],
        "important_levels": [{"price": 1.0, "role": "SUPPORT", "context_field": "f", "note": "n"}], "scenarios": [{"direction": "BULLISH"}, {"direction": "BEARISH"}],
    }
    one, two = json.dumps(good | {"confidence": 0.1}), json.dumps(good | {"confidence": 0.2})
    texts = [f'{one} and a note {{"x": 1}}', f"draft {one} final {two} {{", f'{{"broken": {one}', f'{{"x": 1}} {{"confidence": 3}}', one[:-20]]
    got = teacher.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False]
    assert [r["analysis"]["confidence"] for r in got[:2]] == [0.1, 0.2]
    assert any(e.startswith("confidence") for e in got[3]["errors"]) and got[4]["errors"] == ["no JSON object in the answer"]


def test_published_configuration(tmp_path):
    """Every published key is read by its name; fixed values."""
    from quillon.operators.sampler import SampleSpec
    from quillon.params import EngineParams, Thresholds, load_yaml

    (tmp_path / "engine.yaml").write_text(
        "ema_periods: [5, 20, 50, 100, 200]\nrsi_period: 14\natr_period: 14\nreturn_periods: [1, 5, 20]\nrealized_vol_window: 21\nvolume_sma_window: 22\nswing_lookback: 3\nequal_level_atr: 0.15\n"
        "level_cluster_atr: 0.5\nlevel_min_touches: 2\nmax_levels_per_side: 4\natr_percentile_window: 252\natr_percentile_min_periods: 60\nefficiency_window: 20\ntrend_er_min: 0.35\nrange_er_max: 0.20\n"
        "event_recency_bars: 10\nlevel_proximity_atr: 0.5\nsetup_fast_ema: 20\nsetup_slow_ema: 50\nohlcv_window_bars: 100\nmax_swings_in_context: 8\nprice_decimals: 4\nratio_decimals: 4\n"
    )
    (tmp_path / "data.yaml").write_text("thresholds:\n  min_gap_pct: 0.02\n  gap_mad_multiplier: 7.0\n  max_bar_range_pct: 0.25\n  max_zero_volume_run: 5\n  max_holiday_business_days: 4\n")
    params, limits = load_yaml(str(tmp_path / "engine.yaml"), EngineParams), load_yaml(str(tmp_path / "data.yaml"), Thresholds, "thresholds")
    assert (params.realized_vol_window, params.volume_sma_window, params.ohlcv_window_bars, params.ema_periods[-1]) == (21, 22, 100, 200)
    assert (limits.gap_mad_multiplier, limits.max_holiday_business_days) == (7.0, 4)
    assert SampleSpec().separation == EngineParams().ohlcv_window_bars and SampleSpec(min_separation=100).separation == 100


def test_contexts_of_chosen_bars_are_those_of_all(spark):
    from quillon.operators.context import context_json
    from tests.test_engine import FAST

    bars = spark.createDataFrame(clean_daily(90), "symbol string, interval string, pos int, ts timestamp, open double, high double, low double, close double, volume double")
    chosen = bars.filter("pos % 13 = 5").select("symbol", "interval", "pos")
    every = {r["pos"]: r["context"] for r in context_json(contexts(bars, params=FAST)).collect()}
    got = {r["pos"]: r["context"] for r in context_json(contexts(bars, chosen, FAST)).collect()}
    assert got == {p: c for p, c in every.items() if p % 13 == 5} and len(got) == 7


def test_context_command_on_a_mixed_folder(spark, tmp_path, capsys):
    """Daily and hourly files of a symbol beside each other: each context has its own higher timeframe; -1 is each file's last bar."""
    import json

    from quillon import cli

    header, start = "Datetime,Open,High,Low,Close,Volume\n", dt.datetime(2024, 1, 1)
    raw = tmp_path / "raw"
    raw.mkdir()
    for interval, n, step in (("1h", 24 * 12, dt.timedelta(hours=1)), ("1d", 100, dt.timedelta(days=1)), ("1mo", 20, dt.timedelta(days=31))):
        lines = [f"{(start + i * step).isoformat()}+00:00,{c},{c + 1},{c - 1},{c},10" for i in range(n) for c in [100 + i % 11]]
        (raw / f"AAA_{interval}.csv").write_text(header + "\n".join(lines) + "\n")
    told = lambda *more: [json.loads(x) for x in (cli.main(["context", str(raw), "--allow-failed", *more]), capsys.readouterr().out)[1].splitlines()]
    last = {c["interval"]: c for c in told("--bar", "-1")}
    assert {i: c["bar_index"] for i, c in last.items()} == {"1h": 287, "1d": 99, "1mo": 19}
    assert {i: (c.get("higher_timeframe") or {}).get("interval") for i, c in last.items()} == {"1h": "1D", "1d": "1W", "1mo": None}
    (tmp_path / "fast.yaml").write_text("ema_periods: [5, 20, 50]\n")
    sampled = told("--count", "3", "--config", str(tmp_path / "fast.yaml"))
    assert [c["bar_index"] for c in sampled if c["interval"] == "1d"] == [50, 66, 82]  # from the longest average on


def test_reports_tell_facts_and_all_checks(spark, tmp_path, capsys, monkeypatch):
    """The report of a file has its facts, its digest and a row for each of the ten checks, in JSON and for people."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows = clean_daily(40)
    rows[5][7] = None
    write(tmp_path / "raw", "A B_1d.csv", [",".join([r[3].isoformat() + "+05:30", *("" if x is None else str(x) for x in r[4:])]) for r in rows])
    assert cli.main(["validate", str(tmp_path / "raw"), "--out", str(tmp_path / "out")]) == 1
    shown = capsys.readouterr().out
    report = json.loads(spark.read.json(str(tmp_path / "out")).first()["report"])
    facts = report["dataset"]
    import hashlib

    assert facts["sha256"] == hashlib.sha256((tmp_path / "raw" / "A B_1d.csv").read_bytes()).hexdigest()
    assert (facts["rows"], facts["declared_interval"], facts["inferred_interval_seconds"], facts["timezone"]) == (40, "1d", 86400, "+05:30")
    assert facts["columns"][0] == "datetime" and facts["first_timestamp"] == "2023-12-31 18:30:00"
    assert [c["check"] for c in report["checks"]] == list(validate.TEN)
    assert [c["check"] for c in report["checks"] if not c["passed"]] == ["missing_values"]
    assert f"| sha256 | {facts['sha256']} |" in shown and "| missing_values | FAIL | 1 | 0 |" in shown and "| abnormal_gaps | PASS | 0 |" in shown
    assert "| missing_values | NULL_VALUE | close | ERROR | 1 | 5 | 2024-01-07 18:30:00 |" in shown


def test_frozen_examples_have_their_contexts(spark, tmp_path, capsys, monkeypatch):
    """What the sample command writes is what the chosen bars' contexts are, and can be scored against."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows = clean_daily(400)
    write(tmp_path / "raw", "CLEAN_1d.csv", [",".join([r[3].isoformat() + "+00:00", *map(str, r[4:])]) for r in rows])
    assert cli.main(["sample", str(tmp_path / "raw"), "--count", "2", "--cutoff", "2026-01-01", "--out", str(tmp_path / "examples")]) == 0
    kind = cli._context_type(spark)
    got = spark.read.schema(f"example_id string, symbol string, interval string, source_file string, bar_index int, as_of string, stratum string, context {kind}").json(str(tmp_path / "examples")).collect()
    bars = csv.scan(spark, str(tmp_path / "raw")).drop("file", *csv.FILE_FACTS)
    whole = {r["pos"]: r["context"] for r in contexts(bars, bars.filter(F.col("pos").isin([r["bar_index"] for r in got])).select("symbol", "interval", "pos")).collect()}
    assert len(got) == 2 and all(r["bar_index"] >= 250 for r in got)
    for r in got:
        assert r["example_id"] == f"CLEAN_1d#{r['bar_index']}" and r["source_file"].endswith("CLEAN_1d.csv") and r["as_of"] == r["context"]["as_of"]
        assert r["stratum"] == f"{r['context']['structure']['trend']}|{r['context']['volatility']['regime']}"
        assert r["context"].asDict(recursive=True) == whole[r["bar_index"]].asDict(recursive=True)


def test_screen_with_candidates(spark, tmp_path, monkeypatch):
    """Sectors come from the candidates file; a symbol without one, and bars without a close, are screened as well."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    for symbol in ("AAA", "BBB"):
        rows = clean_daily(120)
        rows[50][7] = None
        write(tmp_path / "raw", f"{symbol}_1d.csv", [",".join([r[3].isoformat() + "+00:00", *("" if x is None else str(x) for x in r[4:])]) for r in rows])
    (tmp_path / "universe.yaml").write_text("candidates:\n  Energy: [AAA, CCC]\n  Metals: [AAA]\n  Empty:\n")
    assert cli.main(["screen", str(tmp_path / "raw"), "--candidates", str(tmp_path / "universe.yaml"), "--out", str(tmp_path / "screen")]) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "screen")).collect()
    assert {(r["symbol"], r["sector"]) for r in got} == {("AAA", "Energy"), ("BBB", None)}


def test_stream_checkpoint_is_exactly_once(spark, tmp_path):
    """Files come in one batch each; the stream stops before a commit, within one, and after one, and starts again each time."""
    from quillon.streaming import checkpoint

    path, state = str(tmp_path / "records"), str(tmp_path / "state")
    read = lambda: sorted(r["i"] for r in checkpoint.committed(spark, path, "i bigint").collect())
    assert read() == []
    calls = []

    def failing(at):
        def commit(session, where, batch_id):
            calls.append(batch_id)
            if at == "after":
                checkpoint.commit(session, where, batch_id)
            raise InterruptedError("stopped")

        return commit

    def run(committed_by=checkpoint.commit):
        stream = spark.readStream.schema("i bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        started = stream.writeStream.foreachBatch(checkpoint.append_once(path, committed_by)).option("checkpointLocation", state).trigger(availableNow=True).start()
        started.awaitTermination()

    def add(name, *values):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"i": v}) + "\n" for v in values))

    add("a.json", 1, 2)
    with pytest.raises(Exception, match="stopped"):
        run(failing("before"))
    assert read() == []  # written, but not committed
    add("b.json", 3)
    run()
    assert read() == [1, 2, 3]
    add("c.json", 4, 4)
    with pytest.raises(Exception, match="stopped"):
        run(failing("after"))
    run()
    assert read() == [1, 2, 3, 4, 4] and calls == [0, 2]
    run()
    assert read() == [1, 2, 3, 4, 4]
