"""Benchmark decontamination: which words of a document lie inside a passage of a benchmark.

A benchmark item gives windows of 10 consecutive words (an item of fewer words is one window). The
windows' hashes go into a table of bits, some BITS_PER_KEY for each, which every task has as a
constant; it is filled by an aggregation, and ends at MOST_BITS whatever the benchmark's size (beyond
that more positions become candidates, and are verified). Documents are scanned in place: a position whose first words and whose whole window hit bits
becomes a candidate, and only candidates leave the row. They are verified by an equi-join on the
window's words, then counted by document. A window is known by the class of all windows of the same
items, so hits and documents carry keys of fixed size and never lists of items; items are listed once
for each distinct set of classes that documents have. Everything is built-in expressions.

Defined cases: a null or empty text has no words, no hits and isn't contaminated; null items and
items without words give no windows; the windows of an item without an id count, the item doesn't; items or rows that repeat count each once or each by itself;
an empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, without, written

WINDOW = 10
#: What is not a word: everything in ASCII but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the prefilter: 128 KB for up to 65,536 keys, 2 MB at most.
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 1 << 20, 1 << 24, 16
#: Windows up to this many are broadcast for the verification; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != F.lit(""))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """gram, n (its words), words, items (the sorted ids, as strings, of the items that have it), class (of equal items)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    items = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("n"))
    grams = items.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i")).select("item", "n", F.expr("slice(w, i, n)").alias("words"))
    return grams.groupBy("words", "n").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("gram", F.array_join("words", " ")).withColumn("class", _class(F.col("items")))


def _class(names: Column) -> Column:
    """One string for a sorted list of strings; their lengths keep lists apart whatever the strings hold."""
    return F.sha2(F.array_join(F.transform(names, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ","), 256)


def table_bits(keys: int) -> int:
    """Bits of a table for a number of keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys - 1).bit_length()))


def _bits(hashes: DataFrame, bits: int) -> Column:
    """A constant array of bits / 64 numbers with the bit of every value of column h set."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    got = hashes.select(F.shiftright(at, 6).cast("int").alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).collect()
    table = [0] * (bits // 64)
    for r in got:
        table[r["k"]] = r["b"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _set(table: Column, h: Column, bits: int) -> Column:
    word = F.get(table, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def document_hits(docs: DataFrame, windows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, classes (sorted, of the windows hit): a row for each row of docs. windows: a written table."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    keys = windows.select(F.xxhash64("words").alias("h")).union(windows.filter("n > 1").select(F.expr("xxhash64(words[0], words[1])").alias("h"))).union(windows.filter("n = 1").select(F.expr("xxhash64(words[0])").alias("h")))
    n_windows = windows.count()
    size = table_bits(2 * n_windows)
    table = _bits(keys, size)  # one constant of the plan, bound once

    def candidates(w: Column, bits: Column) -> Column:
        n = F.size(w)
        known = lambda h: _set(bits, h, size)

        def starts(i: Column) -> Column:
            first = known(F.xxhash64(F.get(w, i), F.get(w, i + 1))) if lengths != [1] else F.lit(False)
            return first | known(F.xxhash64(F.get(w, i))) if lengths[0] == 1 else first

        def hits(at: Column) -> Column:
            def of(k: int) -> Column:
                gram = lambda i: F.slice(w, i + 1, k)
                there = F.filter(at, lambda i: (i + k <= n) & known(F.xxhash64(gram(i))))
                return F.transform(there, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.array_join(gram(i), " ").alias("g")))

            per = [of(k) for k in lengths]
            return F.concat(*per)

        spots = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), starts)).otherwise(F.array().cast("array<int>"))
        return F.struct(n.cast("long").alias("n_words"), let(spots, hits).alias("hits"))

    words = words_of(F.col(text))
    none = F.struct(F.size(words).cast("long").alias("n_words"), F.array().cast("array<struct<i:int,k:int,g:string>>").alias("hits"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), (let(table, lambda bits: let(words, lambda w: candidates(w, bits))) if lengths else none).alias("c"))
    spread = rows.select("rid", "doc_id", "text_hash", "c.n_words", F.explode_outer("c.hits").alias("hit"))
    known = windows.select("gram", "class")
    if n_windows <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    found = spread.join(known, F.col("hit.g") == F.col("gram"), "left")
    mark = F.when(F.col("gram").isNotNull(), F.struct(F.col("hit.i").alias("i"), F.col("hit.k").alias("k")))
    by_row = found.groupBy("rid", "doc_id", "text_hash", "n_words").agg(F.collect_list(mark).alias("spans"), F.collect_set("class").alias("classes"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.sort_array("spans"), zero, lambda a, s: F.struct((a.n + F.greatest(s.i + s.k - F.greatest(s.i, a.end), F.lit(0))).alias("n"), F.greatest(a.end, s.i + s.k).alias("end")), lambda a: a.n)
    return by_row.select("doc_id", "text_hash", "n_words", covered.cast("long").alias("n_hit"), F.sort_array("classes").alias("classes"))


def item_sets(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """set, items: the sorted items of every distinct, non-empty set of classes among hits. Both are written tables."""
    sets = hits.filter(F.size("classes") > 0).select(_class(F.col("classes")).alias("set"), "classes").groupBy("set").agg(F.first("classes").alias("classes"))
    classes = windows.groupBy("class").agg(F.first("items").alias("items"))
    items = sets.select("set", F.explode("classes").alias("class")).join(classes, "class").select("set", F.explode_outer("items").alias("item"))
    return items.groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    windows = written(benchmark_windows(benchmark, window), "windows")
    hits = written(document_hits(docs, windows), "hits")
    sets = item_sets(hits, windows).select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    sets = written(sets, "item_sets")
    if sets.count() <= BROADCAST_WINDOWS:
        sets = F.broadcast(sets)
    own = F.when(F.size("classes") > 0, _class(F.col("classes"))).alias("set")
    counts = [F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")]
    # Rows without a hit have no set, and a null key is never shuffled to meet one.
    rows = hits.select("doc_id", "n_words", "n_hit", own)
    found = rows.filter("set IS NOT NULL").join(sets, "set", "left").unionByName(rows.filter("set IS NULL"), allowMissingColumns=True)
    return found.select("doc_id", "n_words", "n_hit", *counts, (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a word inside a benchmark window; all columns as they are."""
    hits = document_hits(docs, written(benchmark_windows(benchmark, window), "windows"))
    return without(docs, written(hits.filter("n_hit > 0").select("doc_id", "text_hash"), "contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bw),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bg),
lens AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
dk AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dg),
hit AS (SELECT rid, dk.n, i, item FROM dk JOIN grams USING (n, g)),
spots AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hit, range(10) r(k) WHERE k < n GROUP BY rid),
items AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)"""
