"""Product codes of vectors: each of PARTS consecutive parts becomes the index of its nearest codebook entry.

Components become integers, floor(SCALE * x), so sums, means and distances are exact and don't depend
on the order of rows. A codebook starts as the parts of the vectors of least id; every round assigns
all parts to their nearest entries and replaces an entry by the mean of its parts.

The nearest entry is found in a vantage-point tree over a part position's entries. A node is an entry
with the rest split at the middle of the distances to it; branch and bound leaves out a half whose
ring of distances lies farther than the best entry so far. Rings are rounded outwards and a half at
exactly the best distance is visited, so neither rounding nor a tie loses an entry; distances
themselves are integers. The vectors of a batch go down the tree together.

Tasks sum their own parts by entry, so a shuffle carries one row a task and entry. The driver holds the
codebooks alone, at most PARTS x ENTRIES rows.

Defined cases: a vector that is null, or has a null or non-finite component, is dropped, and so is one
whose length isn't that of the first (least id) of a positive multiple of PARTS; ids that repeat or
are null start a codebook after smaller ones, in order of their vectors; fewer than ENTRIES vectors
give so many entries; distances and sums beyond 64 bits are shown as the largest long; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, in_small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf of the tree, and vectors that go down it together.
LEAF, TOGETHER = 4, 4096
#: Components from here on have squares that could leave 64 bits; such vectors are measured with Python's integers.
LARGE = 1 << 26
MOST = (1 << 63) - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) for each component: int64, or Python integers where any is LARGE."""
    # A finite double from 2^53 on is an integer itself.
    if np.abs(vectors).max(initial=0) < LARGE / SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    whole = [int(x) * SCALE if abs(x) >= 2**53 else int(np.floor(x * SCALE)) for x in vectors.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(vectors.shape)


@dataclass
class Node:
    """An entry, and its halves with the least and largest distance of each, rounded outwards; or the entries of a leaf."""

    entry: int = -1
    halves: tuple = ()
    rings: tuple = ()
    leaf: np.ndarray | None = None


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at or below, and at or above, the square roots of squares below 2^62."""
    near = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return np.maximum(near - 1, 0), near + 2


def build(entries: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """The tree over entries (int64 rows). The vantage point is an entry farthest from the first one."""
    ids = np.arange(len(entries)) if ids is None else ids
    if len(ids) <= LEAF:
        return Node(leaf=ids)
    squares = lambda a: ((entries[ids] - entries[a]) ** 2).sum(axis=1)
    entry = int(ids[squares(ids[0]).argmax()])
    far = squares(entry)
    order = np.argsort(far, kind="stable")
    order = order[ids[order] != entry]
    halves, rings = [], []
    for half in (order[: len(order) // 2], order[len(order) // 2 :]):
        low, high = _roots(far[half])
        halves.append(build(entries, ids[half]))
        rings.append((int(low.min()), int(high.max())))
    return Node(entry, tuple(halves), tuple(rings))


class Nearest:
    """The nearest entry of each of some points, and its squared distance; the least index of equals."""

    def __init__(self, entries: np.ndarray, tree: Node, points: np.ndarray):
        self.entries, self.points = entries, points
        self.square = np.full(len(points), MOST)
        self.index = np.zeros(len(points), np.int64)
        self.measured = 0
        self.visit(tree, np.arange(len(points)))

    def measure(self, entry: int, rows: np.ndarray) -> np.ndarray:
        squares = ((self.points[rows] - self.entries[entry]) ** 2).sum(axis=1)
        nearer = (squares < self.square[rows]) | ((squares == self.square[rows]) & (entry < self.index[rows]))
        self.square[rows[nearer]], self.index[rows[nearer]] = squares[nearer], entry
        self.measured += len(rows)
        return squares

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.leaf is not None:
            for entry in node.leaf.tolist():
                self.measure(entry, rows)
            return
        low, high = _roots(self.measure(node.entry, rows))
        gaps = [np.maximum(np.maximum(ring[0] - high, low - ring[1]), 0) ** 2 for ring in node.rings]
        inner_first = gaps[0] <= gaps[1]
        # The nearer half of each point first, then what the best so far doesn't rule out.
        for near_half, first in ((0, inner_first), (1, ~inner_first)):
            self.visit(node.halves[near_half], rows[first & (gaps[near_half] <= self.square[rows])])
            other = 1 - near_half
            self.visit(node.halves[other], rows[first & (gaps[other] <= self.square[rows])])


def _plainly(entries: list[list[int]], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with Python's integers, for components of any size."""
    index, square = [], []
    for p in points.tolist():
        best = min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(entries))
        square.append(best[0])
        index.append(best[1])
    return np.array(index, np.int64), np.array(square, dtype=object)


class Coder:
    """Codes of integer vectors. books: for each part position a list of entries."""

    def __init__(self, books: list[list[list[int]]]):
        self.books = books
        small = all(abs(x) < LARGE for book in books for entry in book for x in entry)
        self.arrays = [np.array(book, np.int64) for book in books] if small else None
        self.trees = [build(a) for a in self.arrays] if small else None

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every vector and part position."""
        parts = vectors.reshape(len(vectors), len(self.books), -1)
        found = []
        for p, book in enumerate(self.books):
            if self.trees and vectors.dtype != object:
                near = Nearest(self.arrays[p], self.trees[p], np.ascontiguousarray(parts[:, p]))
                found.append((near.index, near.square))
            else:
                found.append(_plainly(book, parts[:, p]))
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _pieces(batches: Iterator[pd.DataFrame], vector: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Some rows and their integer vectors; those with LARGE components apart."""
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            rows = batch.iloc[at : at + TOGETHER]
            values = np.stack(rows[vector].to_numpy()).astype(np.float64)
            large = np.abs(values).max(axis=1) >= LARGE / SCALE
            for some in (~large, large):
                if some.any():
                    yield rows[some], integers(values[some])


def usable(rows: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose vector has finite components alone and the right length, and the first ENTRIES of them in order of ids."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & ~bad)
    order = [F.col(vec_id).asc_nulls_last(), F.col(vector)]
    first = kept.orderBy(*order).limit(1).select(F.size(vector)).first()
    kept = kept.filter(F.size(vector) == (first[0] if first else 0))
    return kept, kept.orderBy(*order).limit(ENTRIES)


def _updated(kept: DataFrame, books: list[list[list[int]]], vector: str) -> list[list[list[int]]]:
    """The codebooks after a round: means of the parts of each entry, rounded down; an entry without parts stays."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(books)
        width = len(books[0][0])
        counts, sums = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), width), dtype=object)
        for _, vectors in _pieces(batches, vector):
            index, _ = coder.codes(vectors)
            parts = vectors.reshape(len(vectors), PARTS, width)
            for p in range(PARTS):
                counts[p] += np.bincount(index[:, p], minlength=counts.shape[1])
                part = np.zeros((counts.shape[1], width), vectors.dtype)
                np.add.at(part, index[:, p], parts[:, p])
                sums[p] += part
        p, e = np.nonzero(counts)
        if len(p):
            yield pd.DataFrame({"part": p, "entry": e, "n": counts[p, e], "sums": [list(map(str, sums[a, b])) for a, b in zip(p, e, strict=True)]})

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["n"].sum())
        means = [str(sum(map(int, column)) // n) for column in zip(*own["sums"], strict=True)]
        return pd.DataFrame({"part": own["part"].iloc[:1], "entry": own["entry"].iloc[:1], "means": [means]})

    partial = in_small_batches(kept.select(vector)).mapInPandas(add, "part int, entry int, n bigint, sums array<string>")
    out = [[list(entry) for entry in book] for book in books]
    for r in partial.groupBy("part", "entry").applyInPandas(whole, "part int, entry int, means array<string>").collect():
        out[r["part"]][r["entry"]] = [int(x) for x in r["means"]]
    return out


def train(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, list[list[list[int]]]]:
    """The usable rows, and the codebook of each part position after all rounds (none without rows)."""
    kept, first = usable(rows, vector, vec_id)
    start = [integers(np.array([r[0]], np.float64))[0].tolist() for r in first.select(vector).collect()]
    if not start:
        return kept, []
    width = len(start[0]) // PARTS
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = _updated(kept, books, vector)
    return kept, books


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(kept: DataFrame, books: list[list[list[int]]], vector: str = "embedding", *others: str) -> DataFrame:
    """code (two hex digits a part), error (squared distances summed) and the other columns, for every row of kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(books)
        for rows, vectors in _pieces(batches, vector):
            index, square = coder.codes(vectors)
            text = index.astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield rows[list(others)].assign(code=codes, error=[min(sum(s), MOST) for s in square.tolist()])

    fields = ", ".join(f"{c} string" for c in others)
    plain = in_small_batches(kept.select(vector, *[F.col(c).cast("string").alias(c) for c in others]))
    return plain.mapInPandas(run, f"{fields}{', ' if fields else ''}code string, error bigint")


def report(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row."""
    kept, books = train(rows, vector, vec_id)
    kept = kept.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("label"))
    coded = written(encode(kept, books, "vector", "vec_id", "label"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = written(coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    id_type = rows.schema[vec_id].dataType
    out = attach(coded, totals, "label", "n", coded.count())
    return out.select(F.col("vec_id").cast(id_type).alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    def assign(k: int, made: str = "") -> str:
        distance = "list_sum(list_transform(list_zip(a.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"a{k} AS (SELECT a.rid, a.p, min({distance} * 64 + c.e) AS best FROM parts a JOIN c{k} c ON c.p = a.p GROUP BY a.rid, a.p)"

    def update(k: int) -> str:
        return f"""s{k} AS (SELECT p, best % 64 AS e, j, sum(q[j]) AS s, count(*) AS n FROM a{k} JOIN parts USING (rid, p), unnest(range(1, len(q) + 1)) t(j) GROUP BY ALL),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{k} GROUP BY p, e),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""

    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT rid, p, v[(p * len(v) // 16 + 1) : ((p + 1) * len(v) // 16)] AS q FROM kept, range(16) t(p)),
c0 AS (SELECT p, rid - 1 AS e, q FROM parts WHERE rid <= 64),
{assign(0)}, {update(0)}, {assign(1)}, {update(1)}, {assign(2)},
coded AS (SELECT rid, string_agg(lower(printf('%02x', (best % 64)::INT)), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(q[j]::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM c2, unnest(range(1, len(q) + 1)) t(j))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (rid), books"""
