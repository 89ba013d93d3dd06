"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

A run of letters is cut where the script changes and into pieces of WORD_LETTERS at most, each a word
of its own. A word's script (by code ranges) leaves the languages that were seen in that script; each of them
scores the word by a character model of order two, learned from labelled texts. Viterbi over the
words, with a penalty for a switch, labels spans; the prediction is the language of most letters.

The model is fitted on at most TRAIN_ROWS labelled rows, chosen by the hash of their id; every text
is predicted, whole. Nothing is shuffled but the model's counts; words become counts of grams where
they are, and the driver gets the grams.

Defined cases: a null text or one without letters is ``und`` with score 0; words of a script that no
language was learned in don't vote, and a text of such words alone gets the most common language
with score 0; without labelled rows all is ``und``; equal rows get a row each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, map_frames

UNDETERMINED = "und"
#: Labelled rows that a model is fitted on.
TRAIN_ROWS = 12_000
#: A word that is found n times counts 1 + ln n times, in parts of this; sums of whole numbers don't depend on their order.
PARTS = 1_000_000
#: Cost of a change of language between two words, and the most that one word can speak for a language, in nats.
SWITCH, WORD_LIMIT = 8.0, 3.0
#: A script is a language's if this share of its words are in it.
SCRIPT_SHARE = 0.005
#: Texts that are labelled side by side.
BATCH = 2000
#: Words whose scores a task remembers before it starts anew, and the most letters of a word; longer runs are more words.
CACHED_WORDS, WORD_LETTERS = 300_000, 40

#: First code of each range, and its script.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x20000, "Han"),
)
_STARTS = [a for a, _ in SCRIPTS]
_WORDS = re.compile(r"[^\W\d_]+")


def _one_script() -> re.Pattern:
    """A piece of a run of letters: of one script, of WORD_LETTERS at most."""
    ends = [*(a - 1 for a in _STARTS[1:]), 0x10FFFF]
    ranges: dict[str, list[str]] = defaultdict(list)
    for (a, name), z in zip(SCRIPTS, ends, strict=True):
        ranges[name].append(f"\\U{a:08x}-\\U{z:08x}")
    return re.compile("|".join(f"[{''.join(r)}]{{1,{WORD_LETTERS}}}" for r in ranges.values()))


_PIECE = _one_script()


def words_of(text: str) -> list[str]:
    """Every letter of a lower-cased text, in words of one script and bounded length."""
    out: list[str] = []
    for run in _WORDS.findall(text):
        if not run.isalpha():  # numbers such as ½ and ², which are no letters
            out.extend(p for letters in "".join(c if c.isalpha() else " " for c in run).split() for p in _PIECE.findall(letters))
        elif len(run) <= WORD_LETTERS and (run.isascii() or max(run) < "\u0370"):
            out.append(run)
        else:
            out.extend(_PIECE.findall(run))
    return out


def script(word: str) -> str:
    """Of a word, all of whose letters have one."""
    if word[0] < "\u0370":
        return "Latin"
    i = bisect_right(_STARTS, ord(word[0])) - 1
    return SCRIPTS[max(i, 0)][1]


class _Grams(dict):
    """Row of a trigram in the score table; one that was never seen has its last two letters' row, or the neutral row 0."""

    def __missing__(self, gram: str) -> int:
        row = self[gram] = self.get(gram[1:], 0) if len(gram) == 3 else 0
        return row


def gram_counts(words: dict[str, int]) -> Counter:
    """(kind, text) -> weight of a language's words: its scripts by words, and grams of one to three characters by parts."""
    out: Counter = Counter()
    for word, n in words.items():
        out["script", script(word)] += n
        w, n = f"  {word} ", round(PARTS * (1 + math.log(n)))
        for i in range(2, len(w)):
            out["3", w[i - 2 : i + 1]] += n
            out["2", w[i - 1 : i + 1]] += n
            out["1", w[i - 1]] += n
    return out


class Model:
    """Character model of each language and the scripts it is written in."""

    def __init__(self, words: dict[str, Counter]):
        self._fit({language: gram_counts(own) for language, own in words.items()})

    @classmethod
    def of_grams(cls, grams: dict[str, Counter]) -> Model:
        model = cls.__new__(cls)
        model._fit(grams)
        return model

    def _fit(self, grams: dict[str, Counter]) -> None:
        of = lambda k, kind: Counter({g: n / PARTS for (x, g), n in grams[k].items() if x == kind})
        scripts = {k: Counter({g: n for (x, g), n in own.items() if x == "script"}) for k, own in grams.items()}
        self.languages = sorted(grams, key=lambda k: (-sum(scripts[k].values()), k))
        self.scripts: dict[str, list[int]] = defaultdict(list)
        for k, language in enumerate(self.languages):
            for s, n in scripts[language].items():
                if n >= SCRIPT_SHARE * sum(scripts[language].values()):
                    self.scripts[s].append(k)
        tri, two, one = ([of(k, kind) for k in self.languages] for kind in "321")
        alphabet = max(2, len({c for x in one for c in x}))
        self.rows, table = _Grams(), [[0.0] * len(self.languages)]
        pair = lambda k, g: (two[k].get(g, 0) + 0.5) / (one[k].get(g[0], 0) + 0.5 * alphabet)
        context = [Counter() for _ in self.languages]
        for k, own in enumerate(tri):
            for g, n in own.items():
                context[k][g[:2]] += n
        for g in sorted({g for x in two for g in x}):
            self.rows[g] = len(table)
            table.append([math.log(pair(k, g)) for k in range(len(self.languages))])
        for g in sorted({g for x in tri for g in x}):
            self.rows[g] = len(table)
            table.append([math.log((tri[k].get(g, 0) + 4 * pair(k, g[1:])) / (context[k].get(g[:2], 0) + 4)) for k in range(len(self.languages))])
        self.table = np.array(table)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each language below the best one for each word, at most WORD_LIMIT; and whether any is written in its script."""
        padded, rows = [f"  {w} " for w in words], self.rows
        flat = self.table[[rows[w[i : i + 3]] for w in padded for i in range(len(w) - 2)]]
        sizes = np.fromiter(map(len, padded), np.int64, len(padded)) - 2
        out = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        scripts = list(map(script, words))
        able = {s: np.isin(np.arange(len(self.languages)), self.scripts.get(s, [])) for s in set(scripts)}
        allowed = np.array([able[s] for s in scripts])
        out[~allowed] = -np.inf
        voting = allowed.any(axis=1)
        out[~voting] = 0
        return np.maximum(out - out.max(axis=1, keepdims=True), -WORD_LIMIT), voting


def spans(emissions: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of each row of each matrix (rows x languages): Viterbi, all matrices side by side.

    A matrix in which no language gains more than half a switch on the best one over any stretch has
    no better path than that one throughout; the others are stepped through together.
    """
    out: list[np.ndarray | None] = [None] * len(emissions)
    hard = []
    for i, e in enumerate(emissions):
        best = int(e.sum(axis=0).argmax()) if len(e) else 0
        run = np.vstack((np.zeros((1, e.shape[1])), np.cumsum(e - e[:, best : best + 1], axis=0)))
        if (run - np.minimum.accumulate(run, axis=0)).max() <= switch / 2:
            out[i] = np.full(len(e), best)
        else:
            hard.append(i)
    hard.sort(key=lambda i: -len(emissions[i]))
    if hard:
        sizes = np.array([len(emissions[i]) for i in hard])
        k = emissions[hard[0]].shape[1]
        flat, first = np.concatenate([emissions[i] for i in hard]), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        back = np.zeros((len(flat), k), np.int8)
        state, every = flat[first].copy(), np.arange(k)
        for t in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            at, s = first[:live] + t, state[:live]
            top = s.argmax(axis=1)
            jump = s[np.arange(live), top][:, None] - switch
            stay = s >= jump
            back[at] = np.where(stay, every, top[:, None])
            state[:live] = np.where(stay, s, jump) + flat[at]
        for j, i in enumerate(hard):
            label = int(state[j].argmax())
            path, steps = np.empty(sizes[j], np.int64), back[first[j] : first[j] + sizes[j]].tolist()
            for t in range(sizes[j] - 1, -1, -1):
                path[t] = label
                label = steps[t][label]
            out[i] = path
    return out


class Labeller:
    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((0, len(model.languages)))

    def _known(self, found: list[list[str]]) -> list[np.ndarray]:
        """Rows of each text's words in self.table; -1: doesn't vote."""
        if len(self.index) > CACHED_WORDS:
            self.index, self.table = {}, self.table[:0]
        index = self.index
        new = list({w for words in found for w in words if w not in index})
        if new:
            scores, voting = self.model.scores(new)
            at = np.where(voting, len(self.table) + np.arange(len(new)), -1)
            index.update(zip(new, at.tolist(), strict=True))
            self.table = np.concatenate((self.table, scores))
        return [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in found]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(prediction, its share of the letters, spans (language, words)) of each text."""
        found = [words_of(t.lower()) if t else [] for t in texts]
        if not self.model.languages:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        known, out = self._known(found), []
        table = self.table
        voting = [table[ids[ids >= 0]] for ids in known]
        letters = [np.fromiter(map(len, words), np.int64, len(words))[ids >= 0] for words, ids in zip(found, known, strict=True)]
        paths = spans(voting)
        for words, path, n in zip(found, paths, letters, strict=True):
            if not words:
                out.append((UNDETERMINED, 0.0, []))
                continue
            if not len(path):
                out.append((self.model.languages[0], 0.0, []))
                continue
            share = np.bincount(path, weights=n, minlength=len(self.model.languages))
            k = int(share.argmax())
            cut = np.flatnonzero(np.diff(path)) + 1
            runs = [(self.model.languages[int(p[0])], len(p)) for p in np.split(path, cut)]
            out.append((self.model.languages[k], float(share[k] / share.sum()), runs))
        return out


def _crc(doc_id: Column, base: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % base


def held_out(doc_id: Column) -> Column:
    return _crc(doc_id, 3) == 1


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fits on the ``rows`` labelled rows outside the held-out third whose ids hash lowest; their words are counted where they are."""
    labelled = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h"))
    last = labelled.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return Model({})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for language, t in zip(b["lang"], b["text"], strict=True):
                by[language].update(words_of(t.lower()))
            rows = [(k, w, n) for k, c in by.items() for w, n in c.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for language, own in b.groupby("lang"):
                got = gram_counts(dict(zip(own["word"], own["n"].astype(int), strict=True)))
                yield pd.DataFrame([(language, kind, g, n) for (kind, g), n in got.items()], columns=["lang", "kind", "gram", "n"])

    words = in_small_batches(labelled.filter(F.col("h") <= last).select("lang", "text")).mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = words.mapInPandas(grams, "lang string, kind string, gram string, n bigint").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    by_language: dict[str, Counter] = defaultdict(Counter)
    # Grams of three characters at most, of a bounded number of rows.
    for r in found.collect():
        by_language[r["lang"]][r["kind"], r["gram"]] = r["n"]
    return Model.of_grams(dict(by_language))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (runs of words and their language) for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for b in (frame.iloc[i : i + BATCH] for frame in batches for i in range(0, len(frame), BATCH)):
            got = labeller.label([t if isinstance(t, str) else None for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "spans": [[{"lang": k, "words": n} for k, n in x[2]] for x in got]})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,words:bigint>>")
