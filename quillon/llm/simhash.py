"""SimHash near-duplicates: fingerprints linked at 4 or fewer differing bits, and their components.

A fingerprint is mapped to its segment bit counts: 32 segments of 2 bits, each count 0 to 2. Two
fingerprints differ in at least as many bits as the Manhattan distance of their counts, so links are
among the pairs within distance 4 there. That range join runs on a grid: of six blocks of segments,
two points within distance 4 agree on at least two, so a cell is a pair of blocks with the counts in
them, and a point lies in 15 cells. Inside a cell the full Manhattan bound sieves, and what is left is
verified bit by bit. Cells are told by a hash that may merge two (more candidates, no fewer).

Equal fingerprints are one point. A cell gives a spanning forest of its links, not its pairs; one
with more than BLOCK points is cut into blocks of hashes, and each pair of blocks is a task of its own.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer than
four words are one shingle; equal rows link; a null id never is a component's id unless all its ids
are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, map_frames, without, written
from .components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit of each block of segments; pairs of blocks agree if at most DISTANCE of six differ.
BLOCK_BITS = (0, 10, 20, 32, 42, 52, 64)
#: Points of a cell that one task compares, and up to how many it compares each with each at once.
BLOCK, SMALL = 8192, 24
#: Shingles that are hashed and counted at a time.
CHUNK = 1 << 16
#: The 32 segment counts, 2 bits each: both bits set is 10, one is 01.
EVEN, ODD = "(fp & 6148914691236517205L)", "(shiftrightunsigned(fp, 1) & 6148914691236517205L)"
EMBEDDING = f"shiftleft({EVEN} & {ODD}, 1) | ({EVEN} ^ {ODD})"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many shingles' hashes have each bit (most significant first), and the number of shingles."""
    from xxhash import xxh64_digest

    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        joined = memoryview(b" ".join(part))
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(SHINGLE, len(part)) - 1
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[: len(part) - k].tolist(), ends[k:].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total, n


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    counts, n = _bit_counts(words)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, fp for every row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": np.fromiter(map(fingerprint, batch["text"]), np.int64, len(batch))})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id bigint, text_hash bigint, fp bigint")


def _linked(f: np.ndarray, th: np.ndarray, other_f, other_th) -> np.ndarray:
    """Manhattan bound of the segment counts first, exact distance on what it leaves."""
    near = np.bitwise_count(th ^ other_th) <= DISTANCE
    near[near] = np.bitwise_count(f[near] ^ (other_f[near] if isinstance(other_f, np.ndarray) else other_f)) <= DISTANCE
    return near


def _forest(f: np.ndarray, th: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of one large cell's links, by breadth-first search over what is unvisited."""
    out, left = [], np.arange(1, len(f))
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        p = queue.pop()
        near = _linked(f[left], th[left], f[p], th[p])
        if near.any():
            got = left[near]
            left = left[~near]
            queue += got.tolist()
            out.append((np.full(len(got), f[p]), f[got]))
    return out


def links(cells: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that span the links within each cell. cells: sorted."""
    u = f.view(np.uint64)
    e = u - ((u >> np.uint64(1)) & np.uint64(0x5555555555555555))
    th = e | ((e >> np.uint64(1)) & np.uint64(0x5555555555555555))
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((first, [len(cells)])))
    out = []
    for a, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += _forest(u[a : a + n], th[a : a + n])
    few = np.repeat((sizes <= SMALL) & (sizes > 1), sizes)
    i = np.flatnonzero(few)
    for d in range(1, SMALL):
        i = i[i + d < len(cells)]
        i = i[cells[i] == cells[i + d]]
        if not len(i):
            break
        near = _linked(u[i], th[i], u[i + d], th[i + d])
        out.append((u[i][near], u[i + d][near]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate([x[k] for x in out]).view(np.int64) for k in (0, 1))
    return np.maximum(a, b), np.minimum(a, b)


def _links_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (cell, fp) sorted by cell. A cell that goes on in the next batch waits for it."""
    rest_c, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        c, f = np.concatenate((rest_c, batch["cell"].to_numpy())), np.concatenate((rest_f, batch["fp"].to_numpy()))
        whole = int(np.searchsorted(c, c[-1])) if len(c) else 0
        rest_c, rest_f = c[whole:], f[whole:]
        if whole:
            yield pd.DataFrame(dict(zip("ab", links(c[:whole], f[:whole]), strict=True))).drop_duplicates()
    if len(rest_c):
        yield pd.DataFrame(dict(zip("ab", links(rest_c, rest_f), strict=True))).drop_duplicates()


def fingerprint_links(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """a > b: pairs of fingerprints whose links span all links. points: a written table of distinct fp."""
    masks = [sum(((1 << BLOCK_BITS[i + 1]) - (1 << BLOCK_BITS[i])) for i in pair) for pair in combinations(range(6), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    embedded = points.select("fp", F.expr(EMBEDDING).alias("e"))
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("e").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    cells = embedded.select("fp", F.explode(keys).alias("cell"))
    large = written(cells.groupBy("cell").count().filter(F.col("count") > block), "large-cells")
    n = large.count()
    if n:
        # Cells in blocks: a point of block i meets the blocks of every pair {i, j}.
        k = F.ceil(F.col("count") / block).cast("int")
        cells = cells.join(F.broadcast(large) if n <= BROADCAST_IDS else large, "cell", "left").withColumn("k", F.coalesce(k, F.lit(1))).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(F.col("i"), j) * F.col("k") + F.greatest(F.col("i"), j)))
        cells = cells.select("fp", "cell", pair.alias("p")).select("fp", F.xxhash64("cell", "p").alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").select("cell", "fp").mapInPandas(_links_of_partition, "a bigint, b bigint").distinct()


def near_duplicate_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, fp, root (least fingerprint of the component), component_id (least doc_id of it) for every row."""
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    roots = written(connected_components(fingerprint_links(points.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    linked = written(points.join(roots, "fp"), "linked")
    ids = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    of_linked = linked.join(ids, "root").select("fp", "root", "component_id")
    of_copies = points.filter("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    known = written(of_linked.union(of_copies), "components")
    return rows.join(known, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicate_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs for each component, all columns as they are.

    It is the one with the least id (null last), and of equal ids the least text hash. Rows that
    repeat both are told apart by nothing; any one of them stays.
    """
    found = written(near_duplicate_components(docs, text, doc_id), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("first")
    groups = written(found.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first"), "groups")
    member = found.join(groups, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    member = written(member.select("root", "doc_id", "text_hash", "stays"), "members")
    out = without(docs, written(member.filter("not stays").select("doc_id", "text_hash"), "near-copies"), doc_id, text)
    repeated = member.filter("stays").groupBy("root").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates([doc_id, text]) if repeated else out
