"""Streams of a batch are given back together, and check sums are the library's."""

import zlib

from pyspark.sql import functions as F

from quire.operators import encode
from quire.sources import files

def test_streams_of_many_documents_come_in_few_frames(spark, monkeypatch):
    monkeypatch.setattr(files, "HELD", 50)
    rows = [(i, b"stream\n" + b"a" * (i % 40) + b"endstream stream\r\nb%dendstream stream\nopen" % i) for i in range(300)] + [(300, b""), (301, b"stream\n" + b"c" * 500 + b"endstream")]
    got = {(r["doc"], r["stream_no"]): bytes(r["body"]) for r in files.stream_rows(spark.createDataFrame(rows, "doc long, content binary").coalesce(1)).collect()}
    expected = {(i, n): encode.inflated(s) for i, c in rows for n, s in enumerate(encode.streams(c))}
    assert got == expected


def test_check_sums_are_the_librarys(spark):
    df = spark.range(50).select(F.when(F.col("id") != 7, F.repeat(F.lit("é\x00z"), (F.col("id") * 700).cast("int")).cast("binary")).alias("b"))
    out = df.select("b", encode.adler32(F.col("b")).alias("a"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["a"] == (None if r["b"] is None else zlib.adler32(bytes(r["b"]))) for r in out.collect())
