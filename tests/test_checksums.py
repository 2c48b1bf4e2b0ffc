"""Adler-32 from joined chunks against the library's."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators.encode import adler32, adler_joined, adler_part, adler_sum


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_chunks_of_any_size(spark, chunk):
    sizes = (0, 1, 5, 300) if chunk < 4096 else (0, 4095, 4096, 4097, 20_000)
    rows = [(bytes((7 * n + k * k) % 256 for k in range(n)),) for n in sizes] + [(b"\xff" * 6000,), (None,)]
    for r in spark.createDataFrame(rows, "b binary").select("b", adler32(F.col("b"), chunk).alias("a")).collect():
        assert r["a"] == (None if r["b"] is None else zlib.adler32(bytes(r["b"])))


def test_joining_is_associative(spark):
    df = spark.createDataFrame([(b"one", b"", b"and three" * 50)], "x binary, y binary, z binary")
    x, y, z = (adler_part(F.col(c)) for c in "xyz")
    got = df.select(adler_sum(adler_joined(adler_joined(x, y), z)).alias("l"), adler_sum(adler_joined(x, adler_joined(y, z))).alias("r")).first()
    assert got["l"] == got["r"] == zlib.adler32(b"one" + b"and three" * 50)
