"""What the operators share: the shared folder, written intermediate tables, shipping of the package."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.shared import drop, new_path, save, shared_dir
from quire.functions.shipping import ship

__all__ = ["drop", "new_path", "prepare", "save", "shared_dir", "table"]

#: Bytes of an Arrow batch sent to Python, so that a run of very long texts does not fill a worker.
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session sets nothing, and ship this package to the executors once."""
    if not spark._jsparkSession.sessionState().conf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(frame: pd.DataFrame, column: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """A batch in pieces of about limit characters each, one row at least."""
    sizes = frame[column].map(len).to_numpy() if len(frame) else []
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield frame.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(frame):
        yield frame.iloc[start:]


def key_text(key: str):
    """A key as text, for the way through pandas, which would make numbers with nulls among them inexact; cast it back after."""
    return F.col(key).cast("string").alias(key)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def file_digest(path: str) -> str:
    import hashlib

    with io.open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
