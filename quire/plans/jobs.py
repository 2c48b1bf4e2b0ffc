"""Whole jobs: report, process and preview over tables of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import shared
from quire.functions.shipping import ship
from quire.operators import encode, kernels, rules, sink


def report(pages: DataFrame, has_text: DataFrame | None = None, sampled: int = 6) -> DataFrame:
    """Report and recommendation of each document of pages (doc, page_no, width, height, channels, data).

    The first pages are chosen by keys alone, and measured where they are read: only metrics are shuffled. Their table
    is written once. Compression is that of the recommended plan. Pages whose number is not above the greatest first
    one are measured, so numbers that leave gaps cost work, not results.
    """
    keys = pages.select("doc", "page_no")
    first = rules.prefix(keys, sampled)
    bound = first.agg(F.max("page_no")).first()[0]
    metrics = kernels.measure_pages(pages.where(F.col("page_no") <= bound) if bound is not None else pages)
    metrics = shared.save(metrics.join(first, ["doc", "page_no"], "left_semi"), "page-metrics")
    docs = shared.save(rules.doc_report(metrics, sampled, keys), "document-metrics")
    docs = docs.join(has_text, "doc", "left") if has_text is not None else docs.withColumn("has_text", F.lit(False))
    advice = rules.override(rules.recommend(docs, F.coalesce("has_text", F.lit(False))), rules.plans(docs))
    return docs.drop("skewed").join(advice, "doc")


def process(pages: DataFrame, spec: dict, dpi: int = 150, selected: DataFrame | Column | None = None, parts: bool = False, **how) -> DataFrame:
    """(doc, content): the selected pages enhanced, encoded by their mode and put together; or (doc, at, bytes), the ranges of the files.

    spec may hold compress: mode, adaptive, encoder, mono_encoder. selected: a condition, which is asked where pages are
    read, or a table (doc, page_no), which encoded pages are joined with, so that the others are encoded in vain; all
    pages if None. Pages are enhanced and encoded where they are read; what is shuffled is encoded. how: titles,
    created and visible, as write_ranges takes them.
    """
    if isinstance(selected, Column):
        pages = pages.where(selected)
    done = encode.encode_pages(pages, spec.get("compress"), lambda p: kernels.enhance(p, spec)[0])
    if isinstance(selected, DataFrame):
        done = done.join(selected.select(F.col("doc").cast("string").alias("doc"), F.col("page_no").cast("int").alias("page_no")), ["doc", "page_no"], "left_semi")
    return sink.write_ranges(done, dpi, **how) if parts else sink.write_documents(done, dpi, **how)


def preview(pages: DataFrame, spec: dict, page_no: int = 0, longest: int = 900) -> DataFrame:
    """(doc, before, after): PNGs of one page of each document, the last up to page_no. What is shuffled is PNGs."""
    import pandas as pd

    chosen = pages.where(F.col("page_no") <= page_no).groupBy("doc").agg(F.max("page_no").alias("page_no"))
    least = chosen.agg(F.min("page_no")).first()[0]
    some = pages.where(F.col("page_no").between(least if least is not None else 0, page_no))

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                p = kernels.shrink(kernels.unpack(r), longest)
                yield pd.DataFrame({"doc": [r.doc], "page_no": [r.page_no], "before": [encode.png(p)], "after": [encode.png(kernels.enhance(p, spec)[0])]})

    ship(pages.sparkSession)
    made = some.select("doc", "page_no", "width", "height", "channels", "data").mapInPandas(run, "doc string, page_no int, before binary, after binary")
    return made.join(chosen, ["doc", "page_no"], "left_semi").drop("page_no")
