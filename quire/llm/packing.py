"""Packing by concatenate and cut.

Pass one encodes every document and stores its ids with the tokens before it in its partition; the partitions'
totals, summed in partition order, give each document a place in one stream. Pass two cuts the stream into fixed
windows: a document that crosses a boundary gives a piece for each window it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .tokens import encoder


def _encode(path: str, end_id: int, key: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, part, before = encoder(path).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in shared.by_bytes(batch, "__q_content", 2_000_000):
                got = [ids(t) + end for t in b["__q_content"]]
                n = np.array([len(x) // 4 for x in got], dtype=np.int64)
                yield pd.DataFrame({key: b[key], "__q_part": part, "__q_before": before + np.cumsum(n) - n, "__q_n": n, "__q_ids": got})
                before += int(n.sum())

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and then end_id; the documents follow each other without gaps, cut at every multiple of
    length, so that only the last sequence is not full. A null or empty text is end_id alone. Repeated rows and
    repeated or null keys are packed each for itself. An empty table gives no pieces. Other columns are ignored,
    whatever their names; a key with the name of a result stands in its place.
    The order is that of the partitions as pass one read them; its table holds it, so a lost executor changes nothing.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    kind = docs.schema[key].dataType
    rows = docs.select(shared.key_text(key), shared.text_or_empty(text).alias("__q_content"))
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("__q_part", T.LongType()), T.StructField("__q_before", T.LongType()), T.StructField("__q_n", T.LongType()), T.StructField("__q_ids", T.BinaryType())])
    held = shared.save(rows.mapInPandas(_encode(tokenizer, end_id, key), schema), "packing")
    # one row for each partition of pass one
    totals = held.groupBy("__q_part").agg(F.sum("__q_n").alias("__q_total"))
    base = totals.select("__q_part", (F.sum("__q_total").over(Window.orderBy("__q_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__q_total")).alias("__q_base"))
    # written, so that its size is known and the ids need not be shuffled to meet it
    base = shared.save(base, "packing-offsets")
    n, at = F.col("__q_n"), F.col("__q_at")
    placed = held.join(base, "__q_part").withColumn("__q_at", F.col("__q_base") + F.col("__q_before"))
    cut = placed.withColumn("__q_sequence", F.explode(F.sequence(F.floor(at / length), F.floor((at + n - 1) / length))))
    window = F.col("__q_sequence") * length
    begin, end = F.greatest(at, window), F.least(at + n, window + length)
    ids = F.substring(F.col("__q_ids"), ((begin - at) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
    found = {"start": begin - at, "length": end - begin, "ids": ids, "doc_tokens": n, "sequence_id": F.col("__q_sequence"), "offset": begin - window}
    return cut.select(F.col(key).cast(kind).alias(key), *[e.alias(c) for c, e in found.items() if c != key])
