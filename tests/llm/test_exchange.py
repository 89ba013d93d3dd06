"""Spelling variants, exact duplicates and vector codes: brute force, odd rows, and the steps that results don't show."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, queries as q, spelling, vector_codes
from quillon.llm.common import attach, written
from tests.conftest import TESTDATA, assert_same

from .test_native import DOCS, awkward

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n: int = 150, width: int = 32, seed: int = 4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, width).astype(np.float32)], int(i) % 5) for i in rng.permutation(n)]
    rows[3] = (rows[3][0], rows[4][1], None)
    odd = [(1000, None, 1), (1001, [None] + [0.0] * (width - 1), 1), (1002, [float("nan")] * width, None), (1003, [float("inf")] + [0.5] * (width - 1), 2), (2**53 + 1, [0.25] * width, None), (2**53 + 2, [-0.25] * width, 7)]
    return rows + odd


WORDY = ["thousand thousands thousand THOUSAND", "thousend thousend thousnd thousnd", "thousand " * 60, "ärgerlich ärgerlich argerlich argerlich", "aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaa aaaaaaaa aaaaaaaaa", "short words only here", "x" * 5000 + " " + "x" * 5000, None, "", "÷×÷×÷×÷ ÷×÷×÷×÷", "ÀÀÀÀÀÀÀ àààààààà àààààààà", "thousanda thousanda thousandb thousandb"]


@pytest.mark.parametrize("rows", ["awkward", "empty"])
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_dedup"])
def test_documents_against_sql(spark, fixture_dir, name, rows):
    docs = [*awkward(), *[(100 + i, t, None, None, None) for i, t in enumerate(WORDY * 2)]] if rows == "awkward" else []
    folder = fixture_dir(documents=(DOCS, docs))
    assert_same(q.queries()[name](spark, folder), q.oracle_sql()[name], folder)


@pytest.mark.parametrize("rows", [vectors(), vectors(9), []])
def test_vectors_against_sql(spark, fixture_dir, rows):
    folder = fixture_dir(embeddings=(VECTORS, rows))
    assert_same(q.op13_vector_codes(spark, folder), q.oracle_sql()["op13_vector_codes"], folder)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_dedup", "op13_vector_codes"])
def test_driver_tables(spark, name):
    folder = f"{TESTDATA}/sf0.001"
    assert_same(q.queries()[name](spark, folder), q.oracle_sql()[name], folder)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, r[1], 1, "x", 2.0, True) for i, r in enumerate(awkward())], "doc_id bigint, text string, n int, word string, fp double, suspect boolean")
    assert exact_dedup.report(docs).count() == docs.count()
    assert exact_dedup.keep_one(docs).columns == docs.columns
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = spark.createDataFrame([(*v, "a", 3, 1.0) for v in vectors(20)], VECTORS + ", code string, error int, vector double")
    assert vector_codes.report(rows).count() == 22


# ------------------------------------------------------- spelling variants


def spelled(rows):
    """The contract in plain Python: every pair of words is compared."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeäß", k=rng.randint(7, 10))) for _ in range(12)]

    def changed(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + (rng.choice("abcdeäß") if kind else "") + w[i + (kind != 2) :]

    words = list(base)
    for w in base:
        words += [changed(w) for _ in range(8)]
        words += [changed(changed(w)) for _ in range(8)]
    rows = []
    for k, w in enumerate(words):
        rows += [(len(rows) + i, w + " ") for i in range(1200 if k < 3 else 110 if k % 7 == 0 else 2 + k % 4)]
    rows += [(None, "thousands of Thousands"), (None, None)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    expected = spelled(rows)
    assert got == expected
    assert any(r[0] and r[0] != r[1] for r in expected.values()), "a chain of forms"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abàÿ", min_size=1, max_size=9), min_size=1, max_size=8))
def test_equal_deletions_have_equal_keys(words):
    strings, keys = defaultdict(set), defaultdict(set)
    for row, place, key in zip(*(x.tolist() for x in spelling.deletion_keys(words)), strict=True):
        left = words[row] if place < 0 else words[row][:place] + words[row][place + 1 :]
        strings[left].add(key)
        keys[key].add(left)
    assert all(len(k) == 1 for k in strings.values()) and all(len(s) == 1 for s in keys.values())


def test_colliding_keys_are_told_apart_by_their_strings(spark, monkeypatch):
    """With every key the same, all words are suspects of each other and the strings decide."""
    rows = [(i, t) for i, t in enumerate(["thousand thousend thousandx otherword otherwerd"] * 3 + ["thousand " * 40])]

    def one_key(batches):
        for frame in batches:
            row, place, _ = spelling.deletion_keys(frame["word"].tolist())
            yield frame.iloc[row][["id"]].assign(key=7, place=place.astype(np.int32))[["key", "place", "id"]]

    monkeypatch.setattr(spelling, "_keys_of_batches", one_key)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == spelled(rows) and any(r[0] for r in got.values())


def test_groups_over_batch_borders():
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"key": rng.integers(0, 60, 800), "place": rng.integers(-1, 4, 800).astype(np.int32), "id": np.arange(800)}).sort_values(["key", "place"], ignore_index=True)
    whole = pd.concat(spelling._shared_of_partition(iter([rows])))
    parts = pd.concat(spelling._shared_of_partition(iter(rows.iloc[i : i + 7].reset_index(drop=True) for i in range(0, 800, 7))))
    order = ["replaced", "id"]
    assert whole.sort_values(order).values.tolist() == parts.sort_values(order).values.tolist() and len(whole)


# ------------------------------------------------------- exact duplicates


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), min_size=1, max_size=200), st.integers(0, 44))
def test_golomb_codes_come_back(values, k):
    values = np.array(sorted(values), np.uint64)
    code, own = exact_dedup.coded(values, 1 << 40)
    assert exact_dedup.decoded(code, len(values), own).tolist() == values.tolist()
    gaps = np.diff(values, prepend=np.uint64(0)) >> np.uint64(26)  # keeps the unary part short for a small k
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(gaps, k), len(gaps), k).tolist() == gaps.tolist()


def test_codes_are_short():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 1 << 20).astype(np.uint64))
    code, _ = exact_dedup.coded(values, 1 << 30)
    assert len(code) * 8 / len(values) < 10 + 2.1


@pytest.mark.parametrize("slack", [-6, 0, 10])
def test_collisions_are_verified_on_bytes(spark, slack):
    """With fingerprints of a few bits every text is a suspect; only equal ones are a group."""
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(120)}") for i in range(200)] + [(i, "hot copy") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.Texts(docs, slack_bits=slack).judged().collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}


def test_only_suspects_pass_the_table(spark):
    rows = spark.range(20000).selectExpr("id AS fp")
    suspects = written(spark.range(0, 20000, 50).selectExpr("id AS fp"), "suspects")
    got = {r["fp"] for r in exact_dedup.marked(rows, suspects).filter("suspect").collect()}
    assert set(range(0, 20000, 50)) <= got and len(got) < 400 + 20000 / 8


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a", "p"), (2, "a", "q"), (2, "a", "r"), (None, "a", "s"), (None, None, "t"), (None, "", "u"), (7, "b", "v"), (7, "c", "w"), (7, "c", "x"), (2**53 + 1, "d", "y"), (2**53, "d", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    kept = exact_dedup.keep_one(docs).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter([(2, "a"), (None, ""), (7, "b"), (7, "c"), (2**53 + 1, "d")])
    assert sum(r["kept"] for r in exact_dedup.report(docs).collect()) == 5


def test_hot_keys_come_by_broadcast(spark):
    rows = written(spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id) END AS k", "id"), "rows")
    totals = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k != '1'"), "totals")
    got = attach(rows, totals, "k", "n", 6000)
    assert {(r["k"], r["id"], r["n"]) for r in got.collect()} == {("hot" if i % 3 == 0 else str(i), i, 2000 if i % 3 == 0 else None if i == 1 else 1) for i in range(6000)}


# ------------------------------------------------------- vector codes


def quantised(rows, rounds=2):
    """The contract in plain Python, every entry measured."""
    kept = sorted(((i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[0])
    width = len(kept[0][1]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                members[p, nearest(p, part(v, p))[1]].append(part(v, p))
        for (p, e), own in members.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = {}, Counter()
    for i, v, label in kept:
        found = [nearest(p, part(v, p)) for p in range(16)]
        out[i] = ["".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label]
        by_label[label] += out[i][1]
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return {i: (code, error, by_label[label], hashlib.sha256(text.encode()).hexdigest()) for i, (code, error, label) in out.items()}


def test_codes_against_every_entry(spark):
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_codes.report(spark.createDataFrame(vectors(), VECTORS)).collect()}
    assert got == quantised(vectors())


def test_components_beyond_64_bits(spark):
    rows = vectors(70, 16)[:70] + [(500, [3e38] * 16, 1), (501, [-3e38] + [0.0] * 15, 1), (502, [1e12] * 16, 2)]
    got = {r["vec_id"]: (r["code"], r["error"], r["codebooks_sha256"]) for r in vector_codes.report(spark.createDataFrame(rows, VECTORS)).collect()}
    plain = quantised([(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in rows])
    assert got == {i: (code, min(error, 2**63 - 1), h) for i, (code, error, _, h) in plain.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
def test_trees_find_what_all_distances_find(entries, width, spread, seed):
    """Small coordinates make many ties and equal entries; large ones need the outward rounding."""
    rng = np.random.default_rng(seed)
    high = (3, 40, 5000, vector_codes.LARGE)[spread]
    own, points = rng.integers(-high, high, (entries, width)), rng.integers(-high, high, (300, width))
    near = vector_codes.Nearest(own, vector_codes.build(own), points)
    squares = ((points[:, None] - own[None]) ** 2).sum(axis=2)
    assert near.index.tolist() == squares.argmin(axis=1).tolist() and near.square.tolist() == squares.min(axis=1).tolist()


def test_trees_leave_entries_out():
    rng = np.random.default_rng(5)
    own, points = rng.integers(-500, 500, (64, 2)), rng.integers(-500, 500, (2000, 2))
    assert vector_codes.Nearest(own, vector_codes.build(own), points).measured < 0.5 * 64 * 2000


def test_lengths_and_ids(spark):
    rows = [(5, [0.1] * 16, 1), (None, [0.2] * 16, 1), (6, [0.1] * 15, 1), (7, [], 1), (8, [0.1] * 32, 1), (5, [0.1] * 16, 1), (5, [0.05] * 16, 2)]
    got = vector_codes.report(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([5, 5, 5, None])
    assert {r["code"] for r in got if r["label_error"] == 0} == {r["code"] for r in got}
