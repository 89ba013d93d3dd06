"""Spelling variants: words one edit apart, and the much more frequent word that each one is a form of.

Every word gives an integer key for itself and one for each of its single deletions. A key is a
polynomial hash modulo 2^64, and the hash of a deletion is the word's prefix hash plus its suffix hash
moved one place down, so NumPy makes the keys of a batch of words in a few steps and no deleted string
is built. Keys are dealt out by their leading bits, sorted, and only those that several words share go
on. There the strings themselves are compared; a hash alone never makes two words near.

- Two words of one length that agree without place i differ in place i alone: all words of such a
  group are near each other, and a pair meets in one group.
- A word that is a deletion of others is near all of these.

So a group needs only its size and its two most frequent words, never its pairs. A group has at most
90 letters' worth of words at a place.

Defined cases: a null text has no words; a null id counts as an empty one in ``<id>:<run>``; repeated
rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, in_small_batches, written

#: Least code points and occurrences of a word, and how many times as frequent its form is.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: Runs whose hash this number divides lose a code point.
THINNED = 31
#: Maximal runs of at least LENGTH; shorter ones can't become words.
RUNS = rf"[A-Za-zÀ-ÿ]{{{LENGTH},}}+"
#: Multiplier of the polynomial, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Leading bits of a key that it is dealt out by, and key rows in an Arrow batch.
RADIX_BITS, ROWS = 16, 1 << 17


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the words of all texts, counted map-side before the shuffle."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUNS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shortened = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, shortened).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def _mixed(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spreads hashes over all bits: the leading ones tell the partition."""
    x = x + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key): the key of each word without the code point at place, and of the whole word at place -1."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = sizes.cumsum()
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - (ends - sizes)[row]
    powers = np.full(max(1, int(sizes.max(initial=0))), BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = (points + np.uint64(1)) * powers[place]
    sums = np.concatenate((np.zeros(1, np.uint64), terms.cumsum(dtype=np.uint64)))
    started = sums[ends - sizes]
    whole = sums[ends] - started
    prefix = sums[:-1] - started[row]
    suffix = whole[row] - prefix - terms
    deleted = _mixed(prefix + suffix * np.uint64(INVERSE), sizes[row] - 1)
    return np.concatenate((np.arange(len(words)), row)), np.concatenate((np.full(len(words), -1), place)), np.concatenate((_mixed(whole, sizes), deleted))


def _keys_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        row, place, key = deletion_keys(batch["word"].tolist())
        ids = batch["id"].to_numpy()
        for at in range(0, len(row), ROWS):
            part = slice(at, at + ROWS)
            yield pd.DataFrame({"key": key[part], "place": place[part].astype(np.int32), "id": ids[row[part]]})


def shared(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, sorted by key and place, share a key with a word that has it as its own, and which share key and place with another."""
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    again = np.concatenate((fresh[1:], [True]))
    own = (place == -1)[fresh] & ~again[fresh]
    inserted = own[fresh.cumsum() - 1]
    new_place = fresh | np.concatenate(([True], place[1:] != place[:-1]))
    last = np.concatenate((new_place[1:], [True]))
    return inserted, ~(new_place & last) & (place >= 0)


def _shared_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (key, place, id) sorted by key and place. A key that goes on in the next batch waits for it."""
    rest = None

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        inserted, replaced = shared(rows["key"].to_numpy(), rows["place"].to_numpy())
        kinds = [rows.loc[mask, ["place", "id"]].assign(replaced=kind) for mask, kind in ((inserted, False), (replaced, True))]
        return pd.concat(kinds)

    for batch in batches:
        rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        whole = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1])) if len(rows) else 0
        if whole:
            yield found(rows.iloc[:whole])
        rest = rows.iloc[whole:]
    if rest is not None and len(rest):
        yield found(rest)


def _near(words: DataFrame) -> DataFrame:
    """id, n_near, best (the near word of largest n, least of equals) for each word that has a near one. words: a written table of id, word, n."""
    keys = in_small_batches(words.select("id", "word")).mapInPandas(_keys_of_batches, "key bigint, place int, id bigint")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "place")
    suspects = written(dealt.mapInPandas(_shared_of_partition, "place int, id bigint, replaced boolean"), "shared-keys")
    held = suspects.join(words, "id")
    left = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.col("word").substr(F.lit(1), F.col("place")), F.col("word").substr(F.col("place") + 2, F.length("word"))))
    # Of a run of equal letters one deletion stands for all.
    repeated = ~F.col("replaced") & (F.col("place") > 0) & (F.col("word").substr(F.col("place") + 1, F.lit(1)) == F.col("word").substr(F.col("place"), F.lit(1)))
    held = held.filter(~repeated).select("id", "word", "n", "replaced", (F.col("place") < 0).alias("own"), left.alias("left"), F.when(F.col("replaced"), F.col("place")).otherwise(-1).alias("at"))
    group = Window.partitionBy("left", "at")
    ranked = group.orderBy(F.col("own").desc(), F.col("n").desc(), "word")
    both = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("less"), "word", "own")
    held = held.select("id", "replaced", "own", F.row_number().over(ranked).alias("rank"), F.nth_value(one, 1).over(both).alias("a"), F.nth_value(one, 2).over(both).alias("b"), F.count(F.lit(1)).over(group).alias("size"))
    held = held.filter((F.col("size") > 1) & (F.col("replaced") | F.col("a.own")))
    other = F.when(F.col("rank") == 1, F.col("b")).otherwise(F.col("a"))
    near = held.select("id", F.when(F.col("replaced") | F.col("own"), F.col("size") - 1).otherwise(1).alias("near"), F.struct(other["less"].alias("less"), other["word"].alias("word")).alias("other"))
    return near.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("other").alias("best"))


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root: each round follows twice as many forms as the one before."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        reach = written(reach.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    return reach


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    counted = written(word_counts(docs, text, doc_id), "word-counts")
    words = written(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    known = words.join(_near(words), "id", "left")
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    known = written(known, "forms")
    # A form has RATIO times the count of its word, so no chain is longer than this.
    most = known.agg(F.max("form_n")).first()[0] or 0
    depth = int(math.log(max(most, 1) / OCCURRENCES, RATIO) + 1e-9) if most else 0
    roots = _roots(known.filter("form IS NOT NULL"), math.ceil(math.log2(depth)) if depth > 1 else 0)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 is folded bytewise over its 256-entry table, built from the polynomial.
ORACLE = """
WITH RECURSIVE step AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crctab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
long_runs AS (SELECT id, run, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM long_runs, crctab),
made AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, n, i AS place, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM words, unnest(range(length(word))) t(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.less = b.less AND a.place = b.place AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.less = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.less = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS here, 0 AS d FROM words UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, d) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN ends e ON e.word = f.word"""
