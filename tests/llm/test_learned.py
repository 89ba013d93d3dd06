"""The operators that SQL can't express: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat, language_id, packing, queries as q, simhash, toxicity
from quillon.llm.components import connected_components
from quillon.llm.html_text import main_text
from tests.conftest import TESTDATA

from .test_native import DOCS, awkward

TEXTS = ["", " ", "\n\n x  ½² it's <|endoftext|> b<|endoftext|>", "ünï ΣΊΣ 漢字 🙂 \u00a0", "don't I'LL 12345 ___ ---", "a\r\nb\t c  \n\n\n d", "word " * 3000]


# ---------------------------------------------------------------- packing


def test_ids_are_the_tokenizers_own():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(p.path("byte_bpe_50k.json")), packing.encoder()
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u4").tolist() == [*own.encode(t, add_special_tokens=False).ids, 0]


def test_fast_pattern_says_the_same():
    import public_tokenizers as p
    import regex

    full = regex.compile(p.PATTERN)
    plain = [chr(i) for i in range(0x250) if not packing.SLOW.search(chr(i))]
    assert len(plain) > 570
    for c in plain:
        for t in (c, f"a{c}b", f" {c}", f"1{c}", f"{c}{c} {c}", f"!{c}'s", f"\n{c}\n"):
            assert full.findall(t) == packing.FAST.findall(t), (c, t)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 40])
def test_cut(n):
    got = packing.cut(n, 8)
    assert sum(k for _, k in got) == n and all(k == 8 for _, k in got[1:]) and [s for s, _ in got] == [sum(k for _, k in got[:i]) for i in range(len(got))]
    assert len(got) == -(-n // 8)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(histogram):
    got = packing.plan(histogram, 64)
    ranks, room = defaultdict(list), defaultdict(list)
    for length, first, end, sequence, offset in got:
        ranks[length] += range(first, end)
        for s in range(end - first):
            room[sequence + s].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(room) == list(range(len(room)))


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6, 1.1, 20000).astype(int) + 1, 1, 2048)
    got = packing.plan(dict(Counter(lengths.tolist())))
    sequences = max(s + e - f for _, f, e, s, _ in got)
    assert sequences <= 1.003 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("kind", ["lognormal", "wide", "narrow", "humps", "thirds"])
def test_program_comes_within_a_hundredth_of_its_bound(kind):
    rng = np.random.default_rng(7)
    drawn = {
        "lognormal": rng.lognormal(6, 0.8, 20000),
        "wide": rng.integers(400, 1301, 20000),
        "narrow": rng.integers(600, 761, 20000),
        "humps": np.concatenate((rng.normal(1100, 60, 10000), rng.normal(500, 80, 10000))),
        "thirds": np.concatenate((rng.normal(690, 20, 8000), rng.normal(1050, 30, 4000))),
    }[kind]
    histogram = Counter(np.clip(drawn.astype(int), 1, 2047).tolist())
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in sizes.tolist()], dtype=float)
    amounts, bound = packing.solve(sizes, demand, 2048)
    assert all(sum(p) <= 2048 for p in amounts)
    given_, value = Counter(), sum(amounts.values())
    for pattern, amount in amounts.items():
        for n in pattern:
            given_[n] += amount
    assert all(given_[n] >= (1 - 1e-5) * histogram[n] for n in histogram)
    assert max(bound, demand @ sizes / 2048) * (1 - 1e-5) <= value <= 1.01 * bound
    packed = packing.rounded(histogram)
    assert bound - 1e-6 <= packed.sequences() <= 1.01 * bound + 1
    if kind in ("lognormal", "wide", "narrow"):
        assert packed.dealt >= 0.8 * sum(histogram.values())


def test_packing_of_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    encode = packing.encoder()
    got = packing.pack_documents(docs).collect()
    expected = Counter()
    for doc, text, *_ in awkward():
        blob = encode(text or "")
        for i, (s, n) in enumerate(packing.cut(len(blob) // 4)):
            expected[doc, i, s, n, zlib.crc32(blob[4 * s : 4 * (s + n)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


# ------------------------------------------------------------ language id


def test_spans_are_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        e = -rng.exponential(2.0, (rng.integers(1, 9), 3)).clip(0, 3)
        e[np.arange(len(e)), rng.integers(0, 3, len(e))] = 0
        switch = float(rng.choice([0.5, 2.0, 6.0]))
        path = language_id.spans([e], switch)[0]
        value = lambda p: e[np.arange(len(e)), p].sum() - switch * np.count_nonzero(np.diff(p))
        best = max(value(np.array(p)) for p in np.ndindex(*[3] * len(e)))
        assert abs(value(path) - best) < 1e-9


def test_language_accuracy(spark):
    folder = f"{TESTDATA}/sf0.1"
    got = q.op2_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    words = {"en": "the thing and that was here for them", "fr": "être où la forêt était déjà très belle", "ru": "это было очень хорошо и приятно"}
    rows = [(i, " ".join(words[k].split() * 5), k, None, None) for i in range(30) for k in words]
    rows += [(900, None, "en", None, None), (901, "123 !!", None, None, None), (902, "漢字漢字", None, None, None), (903, "", "fr", None, None), (904, "хорошо было " * 9 + "the thing was " * 3, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3
    assert got[902]["lang_pred"] in words and got[902]["score"] == 0
    assert got[904]["lang_pred"] == "ru" and [s["lang"] for s in got[904]["spans"]] == ["ru", "en"]
    nothing = docs.filter("false")
    assert language_id.predict(nothing, language_id.train(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(nothing)).collect()} == {"und"}


# -------------------------------------------------------------- html text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        ("<nav><a href=x>menu</a></nav><article><h1>Title</h1><p>One <b>bold</b>&nbsp;&amp; two<br>three<p>Four</article><footer>foot</footer>", "Title\nOne bold & two three\nFour"),
        ("<body><header>Site</header><main><p>Body text.</p><aside>side</aside><div class='ad-box'>buy</div><form>name<input></form><script>if (a<b) x('</p>')</script><p>End.</p><section id=comments><p>first!</p></section></main>", "Body text.\nEnd."),
        ("<body class=has-sidebar><div id=header>Site</div><div class='content with-sidebar'><p>" + "words here " * 12 + "</p><div class='article-header'>kept</div></div><div id=sidebar>side</div>", ("words here " * 12).strip() + "\nkept"),
        ("<div class=ad>only this</div>", "only this"),
        ("<main><p>Text.</p><article class=comment><p>mine</p></article></main>", "Text."),
        ("<article><p>unclosed <div class=cookie-notice>we use cookies</div><p>more", "unclosed\nmore"),
        ("<article><!-- <p>no</p> --><p>a &lt;tag&gt; &#233;</p><style>p{}</style></article>", "a <tag> é"),
        ("<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div><h2>Head</h2><p>" + "long text " * 20 + "</p><p>short</p></div>", "Head\n" + ("long text " * 20).strip() + "\nshort"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages_keep_their_articles(spark):
    """Held against the articles cut out by hand from the driver's page form."""
    import html as h

    folder = f"{TESTDATA}/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in q.op4_html_main_text(spark, folder).collect():
        body = pages[r["page_id"]]
        body = re.sub(r"<!--.*?-->", "", body[body.index("<article>") + 9 : body.index("</article>")])
        body = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", body)))
        expected = "\n".join(x for x in (" ".join(h.unescape(line).split()) for line in body.split("\n")) if x)
        assert r["text"] == expected and r["n_chars"] == len(expected)


# ---------------------------------------------------------------- simhash


def brute_components(rows):
    from xxhash import xxh64_intdigest

    prints = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        votes = [0] * 64
        for s in shingles:
            h = xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                votes[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return Counter((doc, f"{p:016x}", least.get(g, doc)) for (doc, _), p, g in zip(rows, prints, group, strict=True))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(60)]
    rows = [(r[0], r[1]) for r in awkward()]
    for k in range(12):
        base = rng.choices(words, k=120)
        for copy in range(6):
            own = list(base)
            for _ in range(copy):
                own[rng.randrange(120)] = rng.choice(words)
            rows.append((100 + 10 * k + copy, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect())
    assert got == brute_components(rows)
    # One row for each component: ids tell components apart but for null ids, so count prints by components.
    kept = simhash.keep_one(docs).collect()
    assert len({r["doc_id"] for r in kept if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in kept)
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {d for d, _, c in got if d is not None and d == c}
    assert simhash.report(docs.limit(0)).count() == 0


def test_links_of_large_cells_in_blocks(spark):
    """Cells cut into blocks link what whole cells link."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64)}
    while len(prints) < 300:
        p = rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        prints.add(p if rng.random() < 0.9 else rng.getrandbits(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    points = spark.createDataFrame([(p,) for p in signed], "fp bigint")

    def groups(block):
        return {(r["node"], r["root"]) for r in connected_components(simhash.fingerprint_links(points, block)).collect()}

    whole = groups(8192)
    assert groups(16) == whole
    root = dict(whole)
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                assert root[a] == root[b]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    pairs = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 150)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)], "none": []}[shape]
    edges = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in root}


# ------------------------------------------------------------------- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "odd <|text|>"]), st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "<<", "[", "|>", " "]), st.text(max_size=4)), max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    text, loss, _ = chat.format_turns([(r, [t]) for r, t in turns])
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_typed_parts():
    parts = [{"type": "text", "text": "see </s>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, "and", {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    text, _, attached = chat.format_turns([("user", parts)])
    assert attached == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 800)]
    assert [m for m in re.findall(r"<\|(?:image|audio|document)\|>", text)] == ["<|image|>", "<|audio|>", "<|document|>"]
    with pytest.raises(ValueError):
        chat.format_turns([("user", [{"type": "video"}])])


# --------------------------------------------------------------- toxicity


def test_toxicity_accuracy(spark):
    folder = f"{TESTDATA}/sf0.1"
    got = {r["doc_id"]: r for r in q.op8_toxicity(spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d in held)
    assert sum(got[d]["predicted"] == labels[d] for d in held) / len(held) > 0.97
    assert sum(got[d]["predicted"] for d in held if labels[d] == 0) <= 0.01 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_folding():
    assert toxicity.fold("You 1d10t! L0ser, $tupid іdіоt ＩＤＩＯＴ 123 Éa!") == " you idiot loser stupid idiot idiot 123 éa "
    assert toxicity.fold("") == " "
    lexicon = toxicity.DEFAULT
    assert lexicon.score("what an idi0t") > 0.5 > lexicon.score("put it in the trash can") and lexicon.score(None) == lexicon.score("") < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert lexicon == toxicity.DEFAULT
    assert toxicity.score_documents(docs, lexicon).count() == docs.count()
    assert toxicity.drop_toxic(docs, lexicon).count() == docs.count()
    odd = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs, odd) == toxicity.DEFAULT


def test_every_letter_of_a_run_is_read():
    """Runs without spaces: cut where the script changes and every 40 letters, so a later language is found."""
    from collections import Counter

    from quillon.llm import language_id

    assert language_id.words_of("a" * 95 + " \u00e9t\u00e9") == ["a" * 40, "a" * 40, "a" * 15, "\u00e9t\u00e9"]
    assert language_id.words_of("okпривет日本語のx") == ["ok", "привет", "日本語", "の", "x"]
    long = "".join(random.Random(1).choices("aбé日のx", k=5000))
    assert "".join(language_id.words_of(long)) == long and {language_id.script(w) for w in language_id.words_of(long)} == {"Latin", "Cyrillic", "Han", "Kana"}
    model = language_id.Model({"en": Counter({"hello": 9, "there": 5}), "ru": Counter({"привет": 9}), "xx": Counter({"zuqzuq": 9})})
    (mixed, late) = language_id.Labeller(model).label(["hello" + "привет" * 60, "hello" * 8 + "zuq" * 400])
    assert mixed[0] == "ru" and [k for k, _ in mixed[2]] in (["en", "ru"], ["ru"])
    assert late[0] == "xx" and late[2][-1][0] == "xx" and sum(n for _, n in late[2]) == 31


def test_names_that_tell_of_headings_or_wrappers():
    body = "A sentence of the article that is long enough to count as text of the page. " * 3
    text = body.strip()
    for inner in ('<h2 id="related-work">Title words</h2>', '<section id="discussion">Title words</section>', '<p id="side-effects">Title words</p>', '<div id="search-methods">Title words</div>', '<div class="share-holders">Title words</div>'):
        assert "Title words" in main_text(f"<article><p>{body}</p>{inner}<p>{body}</p></article>"), inner
    assert "Title words" in main_text(f'<body><p>{body}</p><h2 id="related-work">Title words</h2><p>{body}</p></body>')
    for name in ("comments", "ad", "share"):
        assert "Title words" not in main_text(f'<article><p>{body}</p><div class="{name}">Title words</div><p>{body}</p></article>')
    assert main_text(f'<div class="content-with-sidebar"><p>{body}</p></div><p>stray</p>') == text + "\nstray"
    assert text in main_text(f'<div class="widget-area"><p>{body * 4}</p></div><p>stray</p>')
    assert "Buy" not in main_text(f'<p>{body}</p><div class="sidebar"><p>{"Buy this now. " * 300}</p></div>')
