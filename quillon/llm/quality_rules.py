"""Host-level quality rules: what a document's own rules say, then what its host's record says.

Each text is measured in place by built-in expressions. Failures are summed by host (with map-side
partial sums, so a host with a third of all rows costs one row per task), each host's rate is shrunk
towards the corpus by a beta prior fitted to the hosts themselves, and the few rejected hosts are
joined back to the narrow feature rows.

Defined cases: a null or empty text has no words and fails; a null host has no record and is never
rejected by one; equal rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host whose shrunk failure rate is above this is rejected whole: more of it fails than passes.
HOST_REJECT_RATE = 0.5
#: Limits of the prior's weight, in documents.
PRIOR_STRENGTH = (2.0, 1000.0)
#: Rejected hosts up to this many are broadcast; more are joined by a shuffle, whose hot keys AQE splits.
BROADCAST_HOSTS = 100_000


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that are found twice or more, the first included.

    Linear but for one sort, which only texts with a repeated window pay for.
    """
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def spans(s: Column) -> Column:
            at = lambda k: F.get(s, k).h
            again = F.transform(s, lambda x, k: F.when((x.h == at(k - 1)) | (x.h == at(k + 1)), x.i))
            starts = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(starts, zero, lambda a, p: F.struct((a.n + p + WINDOW - F.greatest(p, a.end)).alias("n"), (p + WINDOW).alias("end")), lambda a: a.n)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, spans))

    return let(hashes, covered)


def document_features(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; keeps no text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != F.lit(""))
    measured = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(host).alias("host"),
        measured.alias("m"),
        (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(features: DataFrame, reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """host, documents, failures, shrunk_rate, rejected.

    The beta prior comes from the hosts' moments: mean m and variance v of their rates give the
    weight m(1 - m)/v - 1, held within PRIOR_STRENGTH.
    """
    hosts = features.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = written(hosts, "hosts")
    rate = F.col("failures") / F.col("documents")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    low, high = PRIOR_STRENGTH
    weight = min(high, max(low, m * (1 - m) / v - 1)) if v else high
    shrunk = (F.col("failures") + F.lit(float(weight * (m or 0)))) / (F.col("documents") + F.lit(float(weight)))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("rejected", F.col("shrunk_rate") > reject_rate)


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """The features and ``kept``: false if the document's own rules fail or its host is rejected."""
    features = written(document_features(docs, text, host, doc_id), "features")
    bad = written(host_verdicts(features, reject_rate).filter("rejected").select(F.col("host"), F.lit(True).alias("host_rejected")), "bad-hosts")
    n = bad.count()
    if n:
        features = features.join(F.broadcast(bad) if n <= BROADCAST_HOSTS else bad, "host", "left")
    else:
        features = features.withColumn("host_rejected", F.lit(None).cast("boolean"))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return features.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are.

    The document's own rules are a filter on the row; hosts with a rejection are anti-joined.
    """
    features = document_features(docs, text, host, doc_id)
    narrow = written(features.select("host", "base_failed"), "host-failures")
    bad = written(host_verdicts(narrow, reject_rate).filter("rejected").select(F.col("host").alias("__host")), "bad-hosts")
    t = "__failed"
    marked = docs.withColumn(t, _own_failure(F.coalesce(F.col(text), F.lit(""))))
    passed = marked.filter(~F.col(t)).drop(t)
    n = bad.count()
    return passed if not n else passed.join(F.broadcast(bad) if n <= BROADCAST_HOSTS else bad, F.col(host) == F.col("__host"), "left_anti")


def _own_failure(t: Column) -> Column:
    words = F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != F.lit(""))
    return let(words, lambda w: F.when(F.size(w) < MIN_WORDS, F.lit(True)).otherwise(100 * _repeat_words(w) > MAX_REPEAT_PERCENT * F.size(w)))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
grams AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM grams),
twice AS (SELECT rid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
spots AS (SELECT DISTINCT rid, i + k AS p FROM twice, range(8) r(k)),
reps AS (SELECT rid, count(*) AS n FROM spots GROUP BY rid),
f AS (SELECT d.doc_id, d.host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN reps USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM b WHERE host IS NOT NULL GROUP BY host),
mom AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least({PRIOR_STRENGTH[1]}, greatest({PRIOR_STRENGTH[0]}, m * (1 - m) / v - 1)) ELSE {PRIOR_STRENGTH[1]} END AS s FROM mom),
rejected AS (SELECT host FROM hosts, prior WHERE (bad + s * m) / (n + s) > {HOST_REJECT_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM rejected)) AS kept FROM b"""
