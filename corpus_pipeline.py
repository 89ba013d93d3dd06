"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes the documents that the one before it kept, whole, and its decisions take effect:
toxic documents go, documents that the quality rules or their host's record reject go, one document
of each near-duplicate group stays, documents with benchmark passages go, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, packing, quality_rules, simhash, toxicity
from quillon.llm.common import table, written
from quillon.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. A null or empty text has no hits and stays; null, repeated and large ids, and other columns, pass unchanged.

    Labels of no document, and null labels, teach nothing; without labels a short fixed lexicon decides.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own rules and host pass. A null, empty or short text fails; a null source has no host record; equal rows stay or go together."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each component: the least id (null last), of equal ids the least text hash; null and empty texts are one component."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window. A null or empty text is clean; null and empty items have no windows; equal rows go together."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces. A null or empty text is one piece, the end id; equal rows are packed each; no documents give no rows."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learned lexicon, fingerprints of 64 bits and byte-pair ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage keeps; each stage's output is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
