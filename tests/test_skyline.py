"""Sizes against bytes that are written, and the encodings that stay against a comparison of all."""

import math

import numpy as np

from quire.operators import skyline

ROWS = "page int, y int, row array<int>"


def written(page, depth, coder):
    out = b""
    for row in page.astype(int) >> (8 - depth):
        if coder == "packed":
            out += np.packbits([int(b) for k in row for b in format(k, f"0{depth}b")]).tobytes()
        for part in (row[i : i + 255] for i in range(0, len(row), 255)) if coder == "runs" else ():
            ends = [*np.flatnonzero(np.diff(part)), len(part) - 1]
            out += b"".join(bytes([e - b, part[e]]) for b, e in zip([-1, *ends], ends))
    return out


def test_sizes_are_those_written(spark):
    rng = np.random.default_rng(2)
    pages = {0: rng.integers(0, 256, (6, 21)), 1: np.full((3, 600), 200), 2: np.repeat(rng.integers(0, 256, (4, 30)), 11, axis=1), 3: np.full((2, 5), 255)}
    df = spark.createDataFrame([(p, y, [int(v) for v in r]) for p, page in pages.items() for y, r in enumerate(page)], ROWS)
    found = skyline.candidates(df).collect()
    assert len(found) == len(pages) * 8
    for r in found:
        page = pages[r["page"]]
        back = (page >> (8 - r["depth"])) * 255 // ((1 << r["depth"]) - 1)
        assert r["bytes"] == len(written(page, r["depth"], r["coder"]))
        error = int(((page - back) ** 2).sum())
        assert r["error"] == error and (r["psnr"] == math.inf if not error else abs(r["psnr"] - 10 * math.log10(65025 * page.size / error)) < 1e-5)


def test_unbeaten_equals_comparison_of_all(spark):
    rng = np.random.default_rng(3)
    rows = [(p, int(d), c, int(rng.integers(1, 9)), int(rng.integers(0, 6))) for p in range(40) for d in (1, 2, 4, 8) for c in ("packed", "runs")]
    got = {tuple(r) for r in skyline.unbeaten(spark.createDataFrame(rows, "page int, depth int, coder string, bytes long, error long")).collect()}
    key = lambda r: (r[3], r[4], r[2], r[1])
    beats = lambda a, b: a[3] <= b[3] and a[4] <= b[4] and key(a) < key(b)
    assert got == {b for b in rows if not any(a[0] == b[0] and beats(a, b) for a in rows)}


def test_odd_rows(spark):
    assert skyline.candidates(spark.createDataFrame([], ROWS)).count() == 0
    odd = skyline.candidates(spark.createDataFrame([(0, 0, None), (0, 1, [])], ROWS)).collect()
    assert {(r["bytes"], r["error"], r["psnr"]) for r in odd} == {(0, 0, None)}
    assert skyline.least_within(skyline.candidates(spark.createDataFrame([(0, 0, [3, 4])], ROWS)), 100.0).collect()[0]["depth"] == 8
