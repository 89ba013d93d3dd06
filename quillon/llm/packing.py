"""Best-fit packing by the configuration linear program.

Documents become token pieces in one pass over the texts. All that the driver sees is the histogram
of piece lengths (2048 numbers). The configuration program over these lengths (one variable for each
way to fill a sequence) is solved by multiplicative weights: an unbounded-knapsack dynamic program
prices patterns, the lengths they cover get cheaper, and so on until all are covered; the prices
also give a lower bound, which tells when the amounts are good enough. The amounts are rounded by
carrying fractions on from pattern to like pattern and dealt; what is left over goes best-fit
decreasing into the room that is left. Several parts of the amounts are tried, down to none, and the
fewest sequences win, so that the result never has more than best-fit decreasing. The outcome is a
table of rank intervals for each length, of a size that doesn't depend on the number of documents;
pieces are ranked within (length, salt) cells and find their sequence by a broadcast range join.

Defined cases: a null or empty text is one piece with the end id alone; equal rows are packed each;
a null id is an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_frames, written

CAPACITY = 2048
END_ID = 0
#: Special token of the vocabulary file and its id; its string in a text is that token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Words whose ids a task remembers, before it starts anew.
CACHED_WORDS = 300_000
#: Pieces of one length that a task ranks: a CELLS-th of all, within these limits.
CELLS, CELL_ROWS = 1024, (1_000, 250_000)
#: Passes and rounds of the program at most, the part of a length's demand that a round covers, the
#: exponent of the weights, how far below the best a pattern may be, and how near the bound is near enough.
PASSES, ROUNDS, STEP, ETA, SLACK, GAP = 4, 300, 0.1, 1.0, 0.02, 0.01
#: Stairs of the simple prices, and the least price a length has, as part of its share of the capacity.
STAIRS, TINY = 8, 1e-6
#: Parts of the program's amounts that are dealt; best-fit does the rest. They are tried in turn.
PARTS = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.4, 0.2, 0.0)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Words(dict):
    """Little-endian ids of a pre-token, computed when first met."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = array("I", self.encode(word)).tobytes()
        return out


#: The vocabulary's pre-token pattern in the standard library's terms, which is faster; it says the
#: same of the characters up to U+024F but for those that SLOW finds: there, letters are what is
#: alphanumeric and no digit, and digits are all numbers.
FAST = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SLOW = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def encoder(ranks_path: str | None = None):
    """text -> its ids and the end id, as little-endian unsigned 32-bit numbers.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its pre-tokens.
    """
    import public_tokenizers
    import regex

    words, full = _Words(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")), regex.compile(public_tokenizers.PATTERN).findall
    find = lambda s: full(s) if SLOW.search(s) else FAST.findall(s)
    special, end = array("I", [SPECIAL_ID]).tobytes(), array("I", [END_ID]).tobytes()
    plain = lambda s: b"".join(map(words.__getitem__, find(s)))
    return lambda text: (special.join(map(plain, text.split(SPECIAL))) if SPECIAL in text else plain(text)) + end


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of several, the first takes the odd part."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(ranks_path)
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc_id"], batch["text"], strict=True):
                blob = ids(t or "")
                view = memoryview(blob)
                rows += [(doc, i, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(blob) // 4, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_frames(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most value that fits into each room from 0 to capacity, by the unbounded-knapsack dynamic program. sizes: ascending."""
    worth = np.full(capacity + 1, -np.inf)
    worth[sizes] = values
    best, least, most = np.zeros(capacity + 1), int(sizes[0]), int(sizes[-1])
    for c in range(least, capacity + 1):
        k = min(c, most)
        best[c] = max(best[c - 1], (best[c - k : c - least + 1][::-1] + worth[least : k + 1]).max())
    return best


def start_prices(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best bound among a few simple prices, and these prices: a length's share of the capacity, or that share in steps
    of 1/k (a share that lies on a step stays as it is, since k + 1 such pieces fill a sequence).

    Prices under which no pattern is worth more than 1 are a dual solution, so the worth of the demand
    is a lower bound; the knapsack program tells what to divide by.
    """
    share, found = sizes / capacity, []
    for k in range(STAIRS + 1):
        prices = np.where((k + 1) * sizes % capacity, (k + 1) * sizes // capacity / k, share) if k else share
        prices = prices + TINY * share
        prices = prices / price(sizes, prices, capacity)[capacity]
        found.append((float(demand @ prices), -k, prices))
    bound, _, prices = max(found, key=lambda x: x[:2])
    return bound, prices


def _cover(sizes: np.ndarray, demand: np.ndarray, capacity: int, start: np.ndarray) -> tuple[dict[tuple[int, ...], float], float, np.ndarray, bool]:
    """One pass of multiplicative weights: patterns (lengths, descending) and amounts, the best bound met, the mean prices, whether all is covered.

    A length's price falls exponentially with the share of its demand that is covered. A round runs
    the knapsack program once and reads many patterns off its table: from each length on, whatever
    keeps the pattern within SLACK of the best, of the lengths that this round may still cover (STEP
    of their demand). Covered lengths leave the pricing.
    """
    n, least, most = len(sizes), int(sizes[0]), int(sizes[-1])
    covered, amounts, bound, mean, open_ = np.zeros(n), defaultdict(float), 0.0, np.zeros(n), np.arange(n)
    at = np.full(capacity + 1, -1)
    at[sizes] = np.arange(n)
    least_amount = 1e-9 * demand
    for _ in range(ROUNDS):
        open_ = np.flatnonzero(covered < 1 - 1e-6)
        if not len(open_):
            break
        prices = np.zeros(n)
        prices[open_] = start[open_] * np.exp(-ETA * (covered[open_] - covered[open_].min()))
        best = price(sizes[open_], prices[open_], capacity)
        prices, best = prices / best[capacity], best / best[capacity]
        bound, mean = max(bound, float(demand @ prices)), mean + prices
        room = np.where(covered < 1 - 1e-6, demand * np.minimum(STEP, 1 - covered), 0.0)
        worth = np.full(capacity + 1, -np.inf)
        usable = room > least_amount
        worth[sizes[usable]] = prices[usable]
        for first in open_[np.argsort(-(prices[open_] + best[capacity - sizes[open_]]), kind="stable")].tolist():
            while room[first] > least_amount[first]:
                pattern, value, c = {first: 1}, prices[first], capacity - int(sizes[first])
                while c >= least:
                    k = min(c, most)
                    ahead = best[c - k : c - least + 1][::-1] + worth[least : k + 1]
                    j = int(ahead.argmax())
                    if value + ahead[j] < 1 - SLACK:
                        break
                    i = int(at[least + j])
                    pattern[i] = pattern.get(i, 0) + 1
                    value += prices[i]
                    c -= least + j
                if value < 1 - SLACK:
                    break
                amount = min(room[i] / a for i, a in pattern.items())
                for i, a in pattern.items():
                    room[i] -= amount * a
                    covered[i] += amount * a / demand[i]
                    if room[i] <= least_amount[i]:
                        worth[sizes[i]] = -np.inf
                amounts[tuple(int(sizes[i]) for i in sorted(pattern, reverse=True) for _ in range(pattern[i]))] += amount
    return amounts, bound, mean / max(mean.max(), 1e-300), not (covered < 1 - 1e-6).any()


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Patterns and amounts that cover the demand, and a lower bound: the configuration program by multiplicative weights.

    Every length counts as itself. A pass starts from the mean prices of the one before; passes end
    when the amounts come within GAP of the bound. The pass of the least amount is taken.
    """
    bound, prices = start_prices(sizes, demand, capacity)
    least, taken = np.inf, {}
    for _ in range(PASSES):
        amounts, met, mean, whole = _cover(sizes, demand, capacity, prices)
        bound = max(bound, met)
        if (value := sum(amounts.values())) < least and whole or not taken:
            least, taken = value if whole else np.inf, amounts
        if least <= (1 + GAP) * bound:
            break
        prices = np.maximum(mean, TINY * sizes / capacity)
    return taken, bound


class _Plan:
    """Runs of equal sequences. A run: its count, its pieces [(length, copies)] in order, its room."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room, self.dealt = capacity, [], defaultdict(list), 0

    def put(self, count: int, pieces: list[tuple[int, int]]) -> None:
        room = self.capacity - sum(n * a for n, a in pieces)
        if room not in self.by_room or not self.by_room[room]:
            if (i := bisect_left(self.rooms, room)) == len(self.rooms) or self.rooms[i] != room:
                insort(self.rooms, room)
        self.by_room[room].append((count, pieces))

    def fit(self, length: int, n: int) -> None:
        """n pieces best-fit: into the least room that takes one, as many as it takes; else into new sequences."""
        while n:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = min(n, self.capacity // length)
                self.put(n // each, [(length, each)])
                n %= each
                continue
            runs = self.by_room[self.rooms[i]]
            count, pieces = runs.pop()
            room = self.rooms[i]
            if not runs:
                del self.rooms[i]
            each = min(n, room // length)
            used = min(count, n // each)
            if count > used:
                self.put(count - used, pieces)
            self.put(used, [*pieces, (length, each)])
            n -= used * each

    def intervals(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, end of ranks, first sequence, offset) for every place of every run."""
        out, rank, sequence = [], defaultdict(int), 0
        for room in sorted(self.by_room):
            for count, pieces in self.by_room[room]:
                offset = 0
                for length, copies in pieces:
                    for _ in range(copies):
                        out.append((length, rank[length], rank[length] + count, sequence, offset))
                        rank[length] += count
                        offset += length
                sequence += count
        return out


    def sequences(self) -> int:
        return sum(count for runs in self.by_room.values() for count, _ in runs)


class _Left:
    """What is left of each length, and the longest that is left up to a length."""

    def __init__(self, lengths: dict[int, int]):
        self.count, self.down = dict(lengths), list(range(max(lengths) + 1))

    def longest(self, n: int) -> int:
        """The longest length up to n of which some is left; 0 without one."""
        n, path = min(n, len(self.down) - 1), []
        while n > 0 and (self.down[n] != n or not self.count.get(n)):
            path.append(n)
            n = self.down[n] if self.down[n] != n else n - 1
        for m in path:
            self.down[m] = n
        return n


def _deal(left: _Left, pattern: tuple[int, ...], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """One sequence of a pattern, and how often what is left allows it; (0, []) if nothing is left for it.

    A length of which none is left is replaced by the longest below it; the last place gets the
    longest that fits into the room the others leave.
    """
    need: dict[int, int] = defaultdict(int)
    room = capacity
    for i, wanted in enumerate(pattern):
        n = left.longest(room if i == len(pattern) - 1 else min(wanted, room))
        while n and left.count[n] == need[n]:
            n = left.longest(n - 1)
        if n:
            need[n] += 1
            room -= n
    pieces = sorted(((n, a) for n, a in need.items() if a), reverse=True)
    return min((left.count[n] // a for n, a in pieces), default=0), pieces


def _rounded(lengths: dict[int, int], patterns: list[tuple[tuple[int, ...], float]], part: float, capacity: int) -> _Plan:
    """``part`` of every pattern's amount is dealt, fractions carried on to the next, like pattern; what is left goes best-fit decreasing."""
    out, left, carried = _Plan(capacity), _Left(lengths), 0.5
    for pattern, amount in patterns:
        carried += amount * part
        count = math.floor(carried)
        carried -= count
        while count:
            run, pieces = _deal(left, pattern, capacity)
            if not (run := min(run, count)):
                break
            for n, a in pieces:
                left.count[n] -= run * a
            out.put(run, pieces)
            out.dealt += run * sum(a for _, a in pieces)
            count -= run
    for n in sorted(left.count, reverse=True):
        out.fit(n, left.count[n])
    return out


def rounded(histogram: dict[int, int], capacity: int = CAPACITY) -> _Plan:
    """The packing of a histogram of lengths, but for full pieces.

    The program is rounded at each of PARTS, and the rounding with the fewest sequences is taken, of
    equals the one that deals most. The last part is 0: never more sequences than best-fit decreasing.
    """
    lengths = {n: c for n, c in histogram.items() if 0 < n < capacity and c}
    if not lengths:
        return _Plan(capacity)
    sizes = np.array(sorted(lengths))
    amounts, _ = solve(sizes, np.array([float(lengths[n]) for n in sizes.tolist()]), capacity)
    patterns = sorted(amounts.items(), reverse=True)
    return min((_rounded(lengths, patterns, part, capacity) for part in PARTS), key=_Plan.sequences)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals that pack a histogram of lengths; every (length, rank) has exactly one place."""
    best = rounded(histogram, capacity)
    if full := histogram.get(capacity):
        best.put(full, [(capacity, 1)])
    return best.intervals()


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, text, doc_id, capacity, ranks_path), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(plan(histogram, capacity), "of bigint, first bigint, end bigint, sequence bigint, offset bigint")
    # A length of many pieces is ranked in many cells, side by side; capacity rows at most.
    cell = min(CELL_ROWS[1], max(CELL_ROWS[0], sum(histogram.values()) // CELLS))
    salts = spark.createDataFrame([(n, 1 + c // cell) for n, c in histogram.items()], "of bigint, salts bigint")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("of")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("of", "salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    # Both tables are bounded: CELLS rows, or one for 250,000 pieces, and one for each length; a few intervals for each length.
    ranked = salted.withColumn("n", F.row_number().over(within)).join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    return ranked.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
