"""What the operators of this subpackage share: the scratch folder, written tables and small column helpers."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ASCII_UPPER, ASCII_LOWER = string.ascii_uppercase, string.ascii_lowercase
#: White space of the word rules: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a temporary one, for tests, only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(f"file://{base}")
        base = f"file://{base}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row.

    A lambda that names an outer expression would have it inlined and computed again for each
    element; a lambda variable over a one-element array can't be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes of the batches that texts go to Python in: a worker holds a few batches, whatever the length of a row.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's batches for Python are bounded by BATCH_BYTES; a smaller bound that is set stays."""
    spark = df.sparkSession
    now = int(re.sub(r"\D", "", spark.conf.get(_BATCH_SETTING)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def map_frames(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """rows.mapInPandas(run, schema) in bounded batches. Columns of longs go in as text, and come out as longs again.

    pandas holds a column of longs with a null among them as doubles, which have no room for an id
    above 2^53; text, or None, passes through unchanged.
    """
    longs = [f.name for f in rows.schema if isinstance(f.dataType, LongType)]
    wanted = StructType.fromDDL(schema)
    outside = [f.name for f in wanted if isinstance(f.dataType, LongType) and f.name in longs]
    inside = StructType([StructField(f.name, StringType()) if f.name in outside else f for f in wanted])
    out = in_small_batches(rows.withColumns({c: F.col(c).cast("string") for c in longs})).mapInPandas(run, inside)
    return out.select(*[F.col(f.name).cast("bigint").alias(f.name) if f.name in outside else f.name for f in wanted])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that an id set may have to be broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't in ``removed`` (a written table of doc_id and text_hash, xxhash64 of the text).

    Null ids and null texts equal themselves. Columns stay as they are.
    """
    gone = removed.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    if removed.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


#: Keys that can each hold a HEAVY-th of all rows: so many rows, at most, are broadcast for them.
HEAVY = 1024


def attach(rows: DataFrame, totals: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows left-joined with totals, one row for each key; both are written tables and no key is null.

    A key with size of at least a HEAVY-th of all n rows comes to its rows by broadcast, so no task
    gets all rows of a hot key; the others are joined by a shuffle.
    """
    often = F.col(size) * HEAVY >= n
    heavy = F.broadcast(totals.filter(often))
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(totals.filter(often).select(key)), key, "left_anti").join(totals.filter(~often), key, "left"))
