"""Encoders of a page side by side: worked out in the row, as over the rows of a page."""

from quire.operators import rules
from quire.queries import QUERIES

ENCODERS = [("zip", 4.5), ("jp2", 1.9), ("jpeg", 1.0), ("jp2lossless", 3.0), ("also", 1.0)]


def test_best_of_row_is_best_encoder(spark):
    sizes = [None, 2, 3, 100, 12_345, -1, -500]
    pages = spark.createDataFrame([(i, q, b) for i, b in enumerate(sizes) for q in (60, 90)], "page long, quality int, bytes long")
    grid = spark.createDataFrame(ENCODERS, "encoder string, factor double")
    long = pages.crossJoin(grid).selectExpr("page", "quality", "encoder", "cast(floor(bytes * factor * quality / 100.0D) as bigint) as bytes")
    key = lambda df: sorted(map(str, df.select("page", "quality", "encoder", "bytes", "times_least", "is_best").collect()))
    expected = key(rules.best_encoder(long, ["page", "quality"]))
    assert key(rules.best_of_row(pages, ENCODERS)) == expected


def test_rows_of_encoders_are_not_sorted(spark):
    plan = QUERIES["enc_bench"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
