"""Toxicity by a weighted lexicon.

A text is folded (case, look-alike letters of other scripts, full-width forms, digits and signs
inside words that stand for letters), cut into words, and run through one Aho-Corasick automaton of
lexicon terms, anchored at word starts, and exception phrases. A hit inside an exception phrase
doesn't count. The weights of the others are summed, once in all and once by length, and a logistic
function of the two gives the score.

The lexicon is learned: words and word beginnings that labelled toxic texts have and clean ones
don't, weighted by their log-odds. A term is as long as it can be without losing toxic texts. The
fit uses at most TRAIN_ROWS rows of each label, chosen by the hash of their id, and counts them where
they are; every term they give is used. Every text is scored, whole, without a shuffle.

Defined cases: a null or empty text has no hits and gets the score of no hits; a null label is no
label; without toxic or clean labels a short fixed lexicon is used; a document that is labelled more
than once is toxic if any label says so; equal rows get a row each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, map_frames, written

#: Rows of each label that are learned from.
TRAIN_ROWS = 4_000
#: Features that a task holds before it hands their counts on.
HELD_FEATURES = 100_000
#: Lengths of the word beginnings that are features; whole words are features of any length.
SHORTEST, LONGEST = 4, 14
#: A term needs toxic texts: this many, and this share; clean texts have it this much less often; a
#: longer term replaces a shorter one if it keeps this share of its toxic texts.
MIN_TEXTS, MIN_SHARE, MIN_LOG_ODDS, KEEPS = 3, 0.004, 2.0, 0.9
#: A term that this share of the toxic texts have is kept; a rarer one only if as many texts as above
#: have fewer than ENOUGH hits of commoner ones, so that the odd words of a few copies stay out.
COMMON_SHARE, ENOUGH = 0.05, 2

#: Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: What stands for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Harmless phrases that have a term in them.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "rodeo clown", "circus clown", "pond scum", "soap scum", "sore loser rule", "lovable loser", "idiot light", "idiot proof")
#: The lexicon where there is nothing to learn from.
DEFAULT_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")

_SIGNS = str.maketrans({k: v for k, v in SUBSTITUTES.items()})
#: Look-alikes, and full-width forms, which lie in the order of ASCII from U+FF01 on.
_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)})
_MIXED = re.compile(r"[\w@$!|]*[0-9@$!|][\w@$!|]*")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The words of a text, folded, each with a space before it and one at the end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if re.search(r"[0-9@$!|]", text):
        text = _MIXED.sub(_unmask, text)
    words = _WORDS.findall(text)
    return f" {' '.join(words)} " if words else " "


def _unmask(m: re.Match) -> str:
    """Signs and digits become letters between or before letters of a word; what ends it, like an exclamation, stays."""
    token = m[0]
    core = token.rstrip("!|$@")
    return core.translate(_SIGNS) + token[len(core) :] if any(c.isalpha() for c in core) else token


def features(folded: str) -> set[str]:
    """' word ' and ' beginning' of every word."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    #: Logistic coefficients: constant, summed weight, summed weight per hundred words.
    logistic: tuple[float, float, float] = (-3.0, 1.0, 0.5)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (term, w))
            for phrase in self.exceptions:
                if (term := f" {phrase} ") not in self.weights:
                    a.add_word(term, (term, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str | None) -> tuple[list[str], int]:
        """The terms hit outside exception phrases, the strongest at each place, and the number of words."""
        folded = fold(text or "")
        found, safe = [], []
        if self.weights or self.exceptions:
            for end, (term, w) in self.automaton().iter(folded):
                (safe if w is None else found).append((end - len(term) + 1, end, term))
        safe.sort()
        starts, reach = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
        best: dict[int, str] = {}
        for start, end, term in found:
            i = bisect_right(starts, start)
            if not i or reach[i - 1] < end:  # no phrase from there or before reaches its end
                if start not in best or self.weights[term] > self.weights[best[start]]:
                    best[start] = term
        return list(best.values()), max(1, folded.count(" ") - 1)

    def measure(self, text: str | None) -> tuple[float, float, int]:
        """(log of the summed weight, summed weight by hundred words, hits) of a text."""
        terms, words = self.hits(text)
        total = sum(map(self.weights.__getitem__, terms))
        return math.log1p(total), 100 * total / (words + 50), len(terms)

    def score(self, text: str | None) -> float:
        a, b, c = self.logistic
        total, rate, _ = self.measure(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * rate))))


DEFAULT = Lexicon({f" {w}": 4.0 for w in DEFAULT_TERMS}, (-3.0, 2.5, 0.2))


def least_texts(toxic: int) -> float:
    """Toxic texts that a term needs."""
    return max(MIN_TEXTS, MIN_SHARE * toxic)


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms and weights from (toxic texts, clean texts) of each feature.

    Going down from a beginning to longer ones, the first that clean texts hardly have starts a
    term; it grows while some longer one keeps nearly all of its toxic texts.
    """
    odds = lambda f: math.log((counts[f][0] + 0.5) / (toxic + 1)) - math.log((counts[f][1] + 0.5) / (clean + 1))
    good = {f for f, (t, _) in counts.items() if t >= least_texts(toxic) and odds(f) >= MIN_LOG_ODDS}
    longer: dict[str, list[str]] = defaultdict(list)
    for f in good:
        longer[f[:-1]].append(f)
    out = {}
    for f in sorted(good):
        if f[:-1] in good:
            continue
        while True:
            following = max(longer.get(f, ()), key=lambda g: counts[g][0], default=None)
            if following is None or counts[following][0] < KEEPS * counts[f][0]:
                break
            f = following
        out[f] = odds(f)
    return out


def needed_terms(candidates: dict[str, float], texts: list[dict[str, int]]) -> dict[str, float]:
    """The candidates that explain the toxic texts, given each text's hits by candidate, counted up to ENOUGH."""
    having: dict[str, list[int]] = defaultdict(list)
    for i, hits in enumerate(texts):
        for f in hits:
            having[f].append(i)
    least = least_texts(len(texts))
    got, out = [0] * len(texts), {}
    for f in sorted(having, key=lambda f: (-len(having[f]), f)):
        if len(having[f]) >= COMMON_SHARE * len(texts) or sum(got[i] < ENOUGH for i in having[f]) >= least:
            out[f] = candidates[f]
            for i in having[f]:
                got[i] += texts[i][f]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, classes weighted alike; the constant isn't shrunk."""
    x = np.column_stack((np.ones(len(x)), x))
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * min(len(y), 2000)
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (share * (p - y)) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon of the labelled rows that aren't held out."""
    y = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("y"))
    y = y.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")  # labels of no document take no place
    ranked = [y.filter(F.col("y") == k).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    # At most 2 x rows ids: a broadcast of known size.
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    sample = written(sample, "toxicity-sample")

    def frame(toxic_texts: Counter, clean_texts: Counter) -> pd.DataFrame:
        every = list(toxic_texts.keys() | clean_texts.keys())
        return pd.DataFrame({"f": every, "t": [toxic_texts[f] for f in every], "c": [clean_texts[f] for f in every]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = (Counter(), Counter())
        for b in batches:
            for k, t in zip(b["y"], b["text"], strict=True):
                own[k].update(features(fold(t or "")))
                if len(own[0]) + len(own[1]) > HELD_FEATURES:
                    yield frame(own[1], own[0])
                    own = (Counter(), Counter())
        if own[0] or own[1]:
            yield frame(own[1], own[0])

    counted = in_small_batches(sample).mapInPandas(count, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    texts_of = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_toxic, n_clean = (n or 0 for n in texts_of)
    if not n_toxic or not n_clean:
        return DEFAULT
    # What choose_terms can use, no more: as many as the toxic texts' features over the texts that each needs.
    log_odds = F.ln((F.col("t") + 0.5) / (n_toxic + 1)) - F.ln((F.col("c") + 0.5) / (n_clean + 1))
    odd = counted.filter((F.col("t") >= least_texts(n_toxic)) & (log_odds >= MIN_LOG_ODDS - 1e-9))
    counts = {r["f"]: (r["t"], r["c"]) for r in odd.collect()}
    candidates = Lexicon(choose_terms(counts, n_toxic, n_clean))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [Counter(candidates.hits(t)[0]) for t in b["text"]]
            yield pd.DataFrame({"terms": [[{"f": f, "n": min(n, ENOUGH)} for f, n in own.items()] for own in hits]})

    texts = in_small_batches(sample.filter("y = 1")).mapInPandas(explain, "terms array<struct<f:string,n:int>>").collect()
    lexicon = Lexicon(needed_terms(candidates.weights, [dict(r["terms"]) for r in texts]))
    if not lexicon.weights:
        return DEFAULT

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [lexicon.measure(t) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "total": [g[0] for g in got], "rate": [g[1] for g in got]})

    seen = in_small_batches(sample).mapInPandas(measure, "y int, total double, rate double").toPandas()
    lexicon.logistic = fit_logistic(seen[["total", "rate"]].to_numpy(), seen["y"].to_numpy())
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = np.array([lexicon.score(t) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": (scores >= 0.5).astype("int32")})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold; all columns as they are."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype=float)

    return in_small_batches(docs).filter(score(F.col(text)) < threshold)
