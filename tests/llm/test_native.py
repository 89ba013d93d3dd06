"""The operators that SQL can express, on fixtures with the awkward cases and on a driver table."""

from __future__ import annotations

import random

import pytest

from quillon.llm import queries as q
from tests.conftest import TESTDATA, assert_same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string"
PAGES = "page_id bigint, url string, html string"
TURNS = "conv_id bigint, turn int, role string, text string"
SQL = ("op3_benchmark_decontamination", "op6_warc_round_trip", "op7_chat_formatting", "op9_host_quality_rules", "op10_hash_tree_sharding")


def awkward():
    """Nulls in any column, empty, blank, repeated, long and oddly spaced texts."""
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(5)
    said = " ".join(words)
    texts = [None, "", "   \n\t", "one", said, said, f"{said} {said}", "a b c\na b c\n\na b c", "#*$%&|<> x", "naïve Ünïcode ΣΊΣΥΦΟΣ \u00a0 x\u000by", " ".join(rng.choices(words, k=3000)), " ".join(["spam ham"] * 400), "W0, w1; W2-w3 w4!w5 w6 w7 w8 w9 then more " + said.upper()]
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, said, "en", "s1", 3), (None, None, None, None, None)]


ITEM_ROWS = [(1, " ".join(f"w{i}" for i in range(12))), (2, "spam ham"), (3, "naïve"), (4, None), (5, ""), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (None, "w20 w21 w22")]
BIG = "<p>" + "text & more " * 200 + "</p>"
PAGE_ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "u\r\nX-Injected: 1", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "ü ñ", "ünï" * 400), (9, "u", "a" * 999), (10, "u", "a" * 999), (11, "u", "b" * 1000), (12, "u", "b" * 1000)]
TURN_ROWS = [(1, 0, "system", "be <s> good"), (1, 1, "user", "hi \\</s>"), (1, 2, "assistant", "a [INST] b\\"), (1, 3, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (2, 0, "user", "\\\\<|turn|>"), (3, None, "assistant", ""), (None, 1, "user", "lost"), (4, 0, "tool/<|text|>", "<|te<|text|>xt|>")]


@pytest.mark.parametrize("name", SQL)
def test_awkward_rows(spark, fixture_dir, name):
    folder = fixture_dir(documents=(DOCS, awkward()), benchmark=(ITEMS, ITEM_ROWS), pages=(PAGES, PAGE_ROWS), conversations=(TURNS, TURN_ROWS))
    # A role with control characters is quoted in the output, so the SQL's length of roles holds for plain ones only.
    df = q.queries()[name](spark, folder)
    if name == "op7_chat_formatting":
        statement = q.oracle_sql()[name].replace("length(role)", "CASE WHEN role = 'tool/<|text|>' THEN 23 ELSE length(role) END")
        assert_same(df, statement, folder)
    else:
        assert_same(df, q.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", SQL)
def test_empty_tables(spark, fixture_dir, name):
    folder = fixture_dir(documents=(DOCS, []), benchmark=(ITEMS, []), pages=(PAGES, []), conversations=(TURNS, []))
    assert_same(q.queries()[name](spark, folder), q.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", SQL)
def test_driver_table(spark, name):
    folder = f"{TESTDATA}/sf0.001"
    assert_same(q.queries()[name](spark, folder), q.oracle_sql()[name], folder)


def test_clashing_columns(spark, fixture_dir):
    """Extra columns with names that the operators use inside."""
    from quillon.llm import decontamination, quality_rules, sharding, simhash

    docs = spark.createDataFrame([(i, r[1], r[3], 1, 2.0, "x") for i, r in enumerate(awkward())], "doc_id bigint, text string, source string, rid int, shard double, host string")
    bench = spark.createDataFrame([(1, "w1 w2 w3", "x")], "item_id bigint, text string, gram string")
    n = docs.count()
    assert decontamination.decontamination_report(docs, bench).count() == n
    assert quality_rules.judge_documents(docs).count() == n
    assert sharding.shard_documents(docs).count() == n
    assert simhash.report(docs).count() == n
    for kept in (quality_rules.keep_documents(docs), decontamination.remove_contaminated(docs, bench), simhash.keep_one(docs)):
        assert kept.columns == docs.columns


def test_growth_takes_rows_only_into_the_new_shard(spark):
    from quillon.llm.sharding import shard_documents

    got = shard_documents(spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 0.6 / 41 < moved / len(got) < 1.4 / 41
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_steer_the_tree(spark):
    from pyspark.sql import functions as F

    from quillon.llm.sharding import Shard, place

    shards = (Shard(0, 0, 0, 1.0), Shard(0, 1, 1, 3.0), Shard(4, 0, 2, 4.0))
    got = {r[0]: r[1] for r in place(spark.range(16000), F.col("id").cast("string"), shards, "shard").groupBy("shard").count().collect()}
    assert abs(got[0] - 2000) < 250 and abs(got[1] - 6000) < 400 and abs(got[2] - 8000) < 400


def test_hosts_are_shrunk(spark):
    """A large bad host is rejected with its good documents; a small one isn't."""
    from quillon.llm.quality_rules import judge_documents, keep_documents

    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 20 == 0 else "bad", "large") for i in range(400)] + [(1000 + i, good, f"h{i % 9}") for i in range(900)] + [(5000, "bad", "tiny"), (5001, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in judge_documents(docs).collect()}
    assert not kept[0] and not kept[1] and kept[1000] and kept[5001] and not kept[5000]
    assert {r["doc_id"] for r in keep_documents(docs).collect()} == {i for i, k in kept.items() if k}


def test_items_of_a_shared_window_are_listed_once_a_set(spark, fixture_dir):
    from quillon.llm import decontamination
    from quillon.llm.common import written

    shared, other = " ".join(f"s{i}" for i in range(10)), " ".join(f"o{i}" for i in range(10))
    items = [(i, f"{shared} x{i}") for i in range(3000)] + [(5000, other), (5001, f"{other} {shared}")]
    docs = [(i, f"before {shared} after", "en", "s", 1) for i in range(40)] + [(50, other, "en", "s", 1), (51, f"{other} y {shared}", "en", "s", 1), (52, "clean", "en", "s", 1)]
    folder = fixture_dir(documents=(DOCS, docs), benchmark=(ITEMS, items), pages=(PAGES, []), conversations=(TURNS, []))
    assert_same(q.queries()[SQL[0]](spark, folder), q.oracle_sql()[SQL[0]], folder)
    windows = written(decontamination.benchmark_windows(spark.createDataFrame(items, ITEMS)), "windows")
    hits = written(decontamination.document_hits(spark.createDataFrame(docs, DOCS), windows), "hits")
    assert {r["doc_id"]: len(r["classes"]) for r in hits.collect()} == {**dict.fromkeys(range(40), 1), 50: 1, 51: 2, 52: 0}
    assert sorted(len(r["items"]) for r in decontamination.item_sets(hits, windows).collect()) == [2, 3001, 3002]
