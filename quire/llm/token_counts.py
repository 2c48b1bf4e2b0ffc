"""Token counts by a digest cache.

The cache is a table of (content digest, token count) under a folder named by the tokenizer's own digest. Texts
join it by the digest of their normalised content; only distinct contents that it lacks are encoded, and their
counts are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of what decides a count: the file, the library's version and the way it is called."""
    import hashlib

    import tokenizers

    said = f"{shared.file_digest(path)} tokenizers {tokenizers.__version__} add_special_tokens=False v1"
    return hashlib.sha256(said.encode()).hexdigest()


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder(path).count
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": [count(t) for t in b["content"]]})

    return run


def _read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    # two runs that append at once may both add a digest; their counts are equal
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with n_bytes (UTF-8) and n_tokens.

    tokenizer: path of a tokenizers file, there on every machine. cache: folder of the cache table, shared;
    it is made if it isn't there, and grows. keep: the columns of docs that are returned (all but the text, if None).

    Null text counts as empty: 0 bytes, 0 tokens. Equal texts are encoded once, whichever rows hold them; repeated
    rows stay repeated. An empty table gives an empty table. Other columns pass through, but ones of docs named
    n_bytes or n_tokens, which the result replaces.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in (text, "n_bytes", "n_tokens")]
    content = shared.text_or_empty(text)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    folder = f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}"
    known = _read_cache(spark, folder)
    lacking = docs.select(digest.alias("digest"), content.alias("content"))
    if known is not None:
        lacking = lacking.join(known.select("digest"), "digest", "left_anti")
    distinct = lacking.groupBy("digest").agg(F.first("content").alias("content"))
    distinct.mapInPandas(_counter(tokenizer), CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(folder)
    known = _read_cache(spark, folder)
    n, kinds = known.agg(F.count("*"), F.count_distinct("digest")).first()
    if n != kinds:
        known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest"))
    out = rows.join(known, "digest", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens")
