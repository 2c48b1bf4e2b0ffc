"""Operators on bands of rows against whole pages, and the tilt of pages that were drawn tilted."""

import numpy as np
import pytest

from quire.operators import bands, kernels, pixels

ROWS = "page int, y int, row array<int>"


def frame(spark, pages):
    return spark.createDataFrame([(p, y, [int(v) for v in row]) for p, page in pages.items() for y, row in enumerate(page)], ROWS).repartition(3)


def whole(df, column):
    found = {}
    for r in df.collect():
        found.setdefault(r["page"], {})[r["y"]] = r[column]
    return {p: np.array([by[y] for y in range(len(by))]) for p, by in found.items()}


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(5)
    # more and fewer rows than a band, a single one, and one pixel
    return {p: rng.integers(0, 256, size).astype(np.uint8) for p, size in enumerate([(70, 23), (16, 5), (17, 40), (1, 9), (1, 1)])}


@pytest.mark.parametrize("lines", [8, 64])
def test_bands_equal_whole_pages(spark, pages, lines):
    df = frame(spark, pages)
    for column, made, plain in (
        ("median", bands.median(df, lines=lines), kernels.median3),
        ("v", bands.sharpen(df, 1.0, lines=lines), kernels.sharpen),
        ("v", bands.descreen(df, lines=lines), kernels.descreen),
    ):
        got = whole(made, column)
        assert got.keys() == pages.keys()
        assert all((got[p] == plain(pages[p])).all() for p in pages)


@pytest.mark.parametrize("radius", [1, 4, 30, 200])
def test_box_sums_of_any_radius(spark, pages, radius):
    df = frame(spark, pages)
    made = bands.box_sums(df, radius, lines=8).cache()
    sums, n = whole(made, "box_sum"), whole(made, "box_n")
    for p, page in pages.items():
        for y, x in np.ndindex(*page.shape):
            box = page[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
            assert (sums[p][y, x], n[p][y, x]) == (box.sum(), box.size)


def test_bands_equal_windows(spark, pages):
    df = frame(spark, {p: pages[p] for p in (0, 1)})
    old = df.selectExpr("page", "y", "posexplode(row) as (x, v)")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(bands.by_pixel(bands.binarize(df, 64, lines=8), {"bit": "bit"})) == rows(pixels.binarize(old, 64).select("page", "y", "x", "bit"))


def test_rows_move_once(spark, pages):
    plan = bands.box_sums(frame(spark, pages), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_odd_rows(spark):
    assert bands.median(spark.createDataFrame([], ROWS)).count() == 0
    assert [r["median"] for r in bands.median(spark.createDataFrame([(0, 0, []), (0, 1, [])], ROWS)).collect()] == [[], []]
    for bad in ([(0, 0, [1]), (0, 2, [1])], [(0, 0, [1]), (0, 0, [1])], [(0, 0, [1]), (0, 1, [1, 2])]):
        with pytest.raises(Exception, match="gaps|same shape"):
            bands.median(spark.createDataFrame(bad, ROWS)).collect()


def lined(tilt, h=300, w=240):
    y, x = np.mgrid[:h, :w]
    at = y - x * np.tan(np.radians(tilt))
    return np.where((at % 20 < 6) & (x % 11 < 8), 20, 240).astype(np.uint8)


def test_skew_by_votes(spark):
    tilts = {0: 0.0, 1: 3.0, 2: -1.5, 3: 7.3, 4: -9.8, 5: 0.1, 6: 0.6}
    pages = {p: lined(t) for p, t in tilts.items()} | {7: np.full((20, 20), 255)}
    got = {r["page"]: r["skew"] for r in bands.skew(frame(spark, pages)).collect()}
    assert got.keys() == pages.keys()
    assert all(abs(got[p] - t) <= 0.2 for p, t in tilts.items()) and got[5] == 0.0 and got[7] == 0.0
