"""A checkpoint of records that a stream appends to, each micro-batch exactly once.

A batch has a folder of its own, by its number, and is told to be there by a commit of its own after
it. A stream that stops between the two repeats the batch under the same number, which replaces what
was written; readers see committed batches alone, so half a batch is never read and no row comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/commits"


def _rows(path: str) -> str:
    return f"{path.rstrip('/')}/rows"


def commit(spark: SparkSession, path: str, batch_id: int) -> None:
    spark.createDataFrame([(batch_id,)], "id bigint").coalesce(1).write.mode("overwrite").json(f"{_commits(path)}/batch={batch_id}")


def append_once(path: str, committed_by: Callable[[SparkSession, str, int], None] = commit) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch and then commits it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{_rows(path)}/batch={batch_id}")
        committed_by(batch.sparkSession, path, batch_id)

    return write


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of committed batches, with batch; none before the first commit."""
    try:
        done = spark.read.schema("id bigint, batch bigint").json(_commits(path)).select("batch").distinct()
        rows = spark.read.schema(f"{schema}, batch bigint").json(_rows(path))
    except Exception as missing:
        if getattr(missing, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return rows.join(done, "batch", "left_semi")
