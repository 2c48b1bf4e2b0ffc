"""Operators of a pixel's surroundings, on rows of pixels (y, row, an array) dealt in bands; and the tilt of lines, by votes.

A band is so many rows of a page, with the rows above and below that its own ones look at. Rows move once, those near a
band's edge to two bands; numpy works inside a band, and nothing holds a page, however many rows it has. A page's rows
are numbered from 0 without gaps and have one length, else the job ends in an error. Pages without rows give none, and
rows without pixels stay so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .pixels import KEYS

#: Rows of a band, at least.
LINES = 64
#: Angles are in tenths of a degree: the greatest, and the steps of the first vote.
WIDEST, COARSE = 100, 10
#: Sines and cosines are whole numbers of this part.
PART = 65536


def around(rows: DataFrame, halo: int, work: Callable[[np.ndarray], tuple[np.ndarray, ...]], columns: dict[str, str], keys=KEYS, lines: int = LINES) -> DataFrame:
    """keys, y, row and columns (name: type of an array) that work makes of a block of rows; a row looks at most halo rows up and down."""
    lines = max(lines, 2 * halo)
    first = F.greatest(F.lit(0), F.floor((F.col("y") - halo) / lines))
    dealt = rows.select(*keys, "y", "row", F.explode(F.sequence(first, F.floor((F.col("y") + halo) / lines))).alias("__q_band"))
    kept = [*keys, "y", "row"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("y")
        y = frame["y"].to_numpy()
        if (np.diff(y) != 1).any():
            raise ValueError("rows of a page are numbered without gaps, each once")
        own = y // lines == frame["__q_band"].iloc[0]
        block = np.stack(frame["row"].to_numpy()).astype(np.uint8)
        made = work(block) if block.size and own.any() else (block,) * len(columns)
        out = frame.loc[own, kept]
        return out.assign(**{name: pd.Series(list(a[own]), index=out.index, dtype=object) for name, a in zip(columns, made, strict=True)})

    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} {t}" for c, t in columns.items()])
    return dealt.groupBy(*keys, "__q_band").applyInPandas(run, schema)


def _summed(block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the pixels within radius, of the table of sums over all that is above and to the left."""
    h, w = block.shape
    table = np.zeros((h + 1, w + 1), dtype=np.int64)
    table[1:, 1:] = block.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    y0, y1, x0, x1 = (f(n) for n in (h, w) for f in (lambda n: np.maximum(0, np.arange(n) - radius), lambda n: np.minimum(n, np.arange(n) + radius + 1)))
    sums = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
    return sums, (y1 - y0)[:, None] * (x1 - x0)[None, :]


def box_sums(rows: DataFrame, radius: int, keys=KEYS, lines: int = LINES) -> DataFrame:
    """box_sum and box_n of each pixel: of those within radius in both directions, cut at the page's edges."""
    return around(rows, radius, lambda block: _summed(block, radius), {"box_sum": "array<long>", "box_n": "array<long>"}, keys, lines)


def binarize(rows: DataFrame, width: int, beta: float = 0.90, keys=KEYS, lines: int = LINES) -> DataFrame:
    """bit of each pixel: 0 where it is darker than beta of the mean around it, else 255; the box grows with the page's width."""
    radius = max(1, max(9, (width // 110) | 1) // 2)

    def work(block: np.ndarray) -> tuple[np.ndarray]:
        sums, n = _summed(block, radius)
        return (np.where(block < sums / n * beta, 0, 255),)

    return around(rows, radius, work, {"bit": "array<int>"}, keys, lines)


def median(rows: DataFrame, keys=KEYS, lines: int = LINES) -> DataFrame:
    """median of the nine pixels around each one, the page's edge repeated."""
    return around(rows, 1, lambda block: (kernels.median3(block),), {"median": "array<int>"}, keys, lines)


def sharpen(rows: DataFrame, amount: float = 1.0, keys=KEYS, lines: int = LINES) -> DataFrame:
    """v of each pixel, away from the mean around it; an amount of 0 changes nothing."""
    return around(rows, 3, lambda block: (kernels.sharpen(block, amount),), {"v": "array<int>"}, keys, lines)


def descreen(rows: DataFrame, keys=KEYS, lines: int = LINES) -> DataFrame:
    """v of each pixel: the median, sharpened."""
    return around(rows, 4, lambda block: (kernels.descreen(block),), {"v": "array<int>"}, keys, lines)


def by_pixel(rows: DataFrame, columns: dict[str, str], keys=KEYS) -> DataFrame:
    """A row for each pixel: keys, y, x, and of each column's array (name: new name) the pixel's entry."""
    return rows.select(*keys, F.col("y").cast("int").alias("y"), F.posexplode(F.arrays_zip(*columns)).alias("x", "p")).select(*keys, "y", "x", *[F.col(f"p.{c}").alias(n) for c, n in columns.items()])


def _voted(dark: DataFrame, angles, keys) -> DataFrame:
    """The angle whose lines hold the pixels most unevenly, the least of equal ones; null without any pixel."""
    turn = F.radians(F.col("angle") / 10)
    up, right = (F.round(f(turn) * PART).cast("long") for f in (F.cos, F.sin))
    votes = dark.withColumn("angle", F.explode(angles)).withColumns({"up": up, "right": right}).withColumn("x", F.explode_outer("xs"))
    lines = votes.groupBy(*keys, "angle", F.shiftright(F.col("y") * F.col("up") - F.col("x") * F.col("right"), 16).alias("line")).agg(F.count("x").alias("n"))
    scores = lines.groupBy(*keys, "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    return scores.groupBy(*keys).agg(F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("angle")).alias("least")))).alias("best")).select(*keys, (-F.col("best.least")).alias("angle"))


def skew(rows: DataFrame, dark: int = 128, keys=KEYS) -> DataFrame:
    """Tilt of a page's lines in degrees, positive where they fall to the right.

    Pixels under dark vote for the line that they lie on, for each angle; whole degrees first, then tenths around the
    best. The sum of squared votes is greatest where lines are met; of equal angles the least one. Under 0.15 it is 0, as
    it is without dark pixels, and it ends at 10 on either side. What is moved is votes, added up in each task first.
    """
    held = rows.select(*keys, F.col("y").cast("long").alias("y"), F.filter(F.transform("row", lambda v, x: F.when(v < dark, x)), lambda x: x.isNotNull()).alias("xs"))
    tenths = lambda a, b, step: F.sequence(a, b, F.lit(step))
    coarse = _voted(held, tenths(F.lit(-WIDEST), F.lit(WIDEST), COARSE), keys).withColumnRenamed("angle", "around")
    near = held.join(coarse.where("around is not null"), list(keys))
    fine = _voted(near, tenths(F.col("around") - COARSE, F.col("around") + COARSE, 1), keys)
    found = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("angle"))) / 10
    return coarse.select(*keys).join(fine, list(keys), "left").select(*keys, F.when(F.abs("angle") >= 1.5, found).otherwise(0.0).alias("skew"))
