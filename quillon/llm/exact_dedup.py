"""Exact duplicates by an exchange of compressed fingerprints.

1. A task reads its rows, takes a short fingerprint of each text (log2 of the number of rows plus
   SLACK_BITS) and sends each owner, a range of fingerprints, the sorted distinct ones as Golomb-coded
   gaps: some SLACK_BITS and two bits a row instead of the text.
2. An owner decodes what it was sent and answers each sender with a bitmap: which of its fingerprints
   another sender has too. What a sender has twice itself it knows already.
3. The senders' marked fingerprints are suspects. A table of their bits, of at most TABLE_WORDS longs,
   is broadcast to a second reading of the texts, which lets suspects pass and few others.
4. Suspect texts are grouped by their bytes. Each task sends one row for a text however many copies it
   has, so a text of a third of all rows is no hot key, and what has no copy is never shuffled.

Rows of a text are told by its SHA-256, which the results carry anyway; that each digest stands for
one text has been verified on the bytes. Of equal texts the row with the largest id stays, and of rows
that repeat that as well, one.

Defined cases: a null text is an empty one; a null id is smaller than any other; equal rows are one
group of which one stays; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, attach, written

#: Bits of a fingerprint beyond log2 of the rows: one row in 2^SLACK_BITS is suspected wrongly.
SLACK_BITS = 10
#: Rows that a sender codes at a time, and rows of an owner.
BLOCK, OWNER_ROWS = 1 << 20, 1 << 18
#: Longs of the suspects' bit table at most (32 MB), and its bits for each suspect. With more suspects it lets more rows pass; none is lost.
TABLE_WORDS, TABLE_BITS = 1 << 22, 16


def golomb_encode(gaps: np.ndarray, k: int) -> bytes:
    """Golomb codes of gaps with the divisor 2^k: all remainders of k bits, then all quotients in unary."""
    gaps = gaps.astype(np.uint64)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = (quotients + 1).cumsum() - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    remainders = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate((remainders.ravel(), unary))).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    remainders = bits[: n * k].reshape(n, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64)) if k else np.zeros(n, np.uint64)
    ends = np.flatnonzero(bits[n * k :])[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    return (quotients.astype(np.uint64) << np.uint64(k)) + remainders


def coded(values: np.ndarray, span: int) -> tuple[bytes, int]:
    """Sorted distinct values below span as codes, and the parameter that suits their density."""
    k = max(0, int(span * 0.69 / max(1, len(values))).bit_length() - 1)
    return golomb_encode(np.diff(values, prepend=np.uint64(0)), k), k


def decoded(code: bytes, n: int, k: int) -> np.ndarray:
    return golomb_decode(code, n, k).cumsum(dtype=np.uint64)


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def exchanged(fingerprints: DataFrame, rows: int, bits: int) -> DataFrame:
    """sender, owner, n, k, code, own (bitmap of what the sender has twice). fingerprints: fp of 64 bits, of which the leading ``bits`` count."""
    owner_bits = min(bits, max(0, (rows // OWNER_ROWS).bit_length()))
    span = 1 << (bits - owner_bits)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            owners = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
            out = []
            for owner in np.unique(owners).tolist():
                a, b = np.searchsorted(owners, (owner, owner + 1))
                code, k = coded(values[a:b] - np.uint64(owner * span), span)
                out.append((f"{task}-{block}", owner, b - a, k, code, _packed(counts[a:b] > 1)))
            return pd.DataFrame(out, columns=["sender", "owner", "n", "k", "code", "own"])

        for batch in batches:
            held.append(batch["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - bits))
            n += len(batch)
            if n >= BLOCK:
                yield flush()
                block, held, n = block + 1, [], 0
        if n:
            yield flush()

    return fingerprints.mapInPandas(send, "sender string, owner bigint, n int, k int, code binary, own binary")


def answered(sent: DataFrame) -> DataFrame:
    """sender, owner, dup: for each sender's fingerprints, in order, a bit that tells whether another sender has it as well."""

    def answer(own: pd.DataFrame) -> pd.DataFrame:
        lists = [decoded(c, n, k) for c, n, k in zip(own["code"], own["n"].tolist(), own["k"].tolist(), strict=True)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        more = values[counts > 1]
        return pd.DataFrame({"sender": own["sender"], "owner": own["owner"], "dup": [_packed(np.isin(x, more, assume_unique=True)) for x in lists]})

    return sent.groupBy("owner").applyInPandas(answer, "sender string, owner bigint, dup binary")


def suspected(sent: DataFrame, answers: DataFrame, rows: int, bits: int) -> DataFrame:
    """fp: the fingerprints, of ``bits`` bits, that more than one row has."""
    owner_bits = min(bits, max(0, (rows // OWNER_ROWS).bit_length()))
    span = 1 << (bits - owner_bits)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, n, k, code, own, dup in zip(*(batch[c].tolist() for c in ("owner", "n", "k", "code", "own", "dup")), strict=True):
                yield pd.DataFrame({"fp": (decoded(code, n, k) + np.uint64(owner * span))[_bits(own, n) | _bits(dup, n)].astype(np.int64)})

    return sent.join(answers, ["sender", "owner"]).mapInPandas(mark, "fp bigint").distinct()


def _place(fp: Column, words: int) -> tuple[Column, Column]:
    """(long, bit in it) of a fingerprint in the table."""
    at = F.pmod(F.xxhash64(fp), F.lit(words * 64))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def marked(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """rows with ``suspect``: true where fp is suspected, and for some others. suspects: a written table of fp."""
    words = min(TABLE_WORDS, max(1, suspects.count() * TABLE_BITS // 64))
    long, bit = _place(F.col("fp"), words)
    of_bit = suspects.select(long.alias("__long"), bit.alias("__bit")).select("__long", F.expr("shiftleft(1L, __bit)").alias("__set"))
    bits = written(of_bit.groupBy("__long").agg(F.bit_or("__set").alias("__set")), "suspect-bits")
    out = rows.withColumns({"__long": long, "__bit": bit}).join(F.broadcast(bits), "__long", "left")
    return out.withColumn("suspect", F.coalesce(F.expr("shiftright(__set, __bit) & 1 = 1"), F.lit(False))).drop("__long", "__bit", "__set")


class Texts:
    """The texts of docs, which of their rows are suspects, and the texts that several rows have."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slack_bits: int = SLACK_BITS):
        content = F.coalesce(F.col(text), F.lit(""))
        full = F.xxhash64(content)
        n = docs.count()
        bits = min(63, max(1, n.bit_length() + slack_bits))
        sent = written(exchanged(docs.select(full.alias("fp")), n, bits), "sent")
        self.n, self.suspects = n, written(suspected(sent, written(answered(sent), "answers"), n, bits), "suspects")
        self.rows = docs.select(F.shiftrightunsigned(full, 64 - bits).alias("fp"), F.col(doc_id).alias("doc_id"), content.alias("text"))

    def repeated(self) -> DataFrame:
        """text_sha256 of the texts that several rows have, equal byte by byte."""
        texts = marked(self.rows, self.suspects).filter("suspect").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        return texts.filter("n > 1").select(F.sha2("text", 256).alias("text_sha256"))

    def judged(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
        repeated = written(self.repeated(), "repeated-texts")
        rows = marked(self.rows, self.suspects).select("doc_id", "suspect", F.sha2("text", 256).alias("text_sha256"))
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("row"))
        suspects = rows.filter("suspect")
        stays = suspects.groupBy("text_sha256").agg(F.max(order).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        stays = written(stays.join(repeated, "text_sha256", "left_semi"), "stays")
        grouped = attach(suspects, stays, "text_sha256", "group_size", self.n)
        alone = F.col("group_size").isNull()
        grouped = grouped.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("row") == -F.col("stays.row"))).alias("kept"), "text_sha256")
        single = rows.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        return grouped.union(single)


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return Texts(docs, text, doc_id).judged()


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns as they are; of rows that repeat id and text any one stays."""
    judged = written(report(docs, text, doc_id), "judged")
    gone = judged.filter(~F.col("kept"))
    removed = written(gone.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct(), "copies")
    digest = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    far = removed.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    if removed.count() <= BROADCAST_IDS:
        far = F.broadcast(far)
    out = docs.join(far, docs[doc_id].eqNullSafe(F.col("__id")) & (digest == F.col("__sha")), "left_anti")
    if gone.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count():
        # A null text equals an empty one here, so the rows are told apart by what counts.
        out = out.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).dropDuplicates([doc_id, "__text"]).drop("__text")
    return out


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""
