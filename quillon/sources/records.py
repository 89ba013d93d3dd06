"""JSON-lines records, checkpoints and prompt templates."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like read_records, but a broken line, such as the last of an interrupted run, is left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Adds rows: one commit for all of them."""
    rows.write.mode("append").json(path)


def load_prompt(folder: str, version: str) -> dict[str, str]:
    """The system, user and repair templates of a version."""
    return {part: (Path(folder) / version / f"{part}.md").read_text(encoding="utf-8") for part in ("system", "user", "repair")}


def prompt_hash(prompt: dict[str, str]) -> str:
    joined = "".join(prompt[part] + "\0" for part in ("system", "user", "repair"))
    return hashlib.sha256(joined.encode()).hexdigest()[:16]
