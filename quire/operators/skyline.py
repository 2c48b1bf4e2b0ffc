"""What a page costs and what it loses: sizes and errors of its encodings, and those that no other one beats.

An encoding keeps the upper bits of gray values and writes them in one of two ways: packed, each row from a whole byte;
or runs, a count and a value in two bytes, where a run ends with its row and at each multiple of 255 pixels. Sizes are
counted and errors summed where rows (y, row, an array) are read; what is moved is a few sums of each page and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import KEYS

#: Bits of a value that are kept.
DEPTHS = (1, 2, 4, 8)
#: Pixels of a run, at most.
RUN = 255


def candidates(rows: DataFrame, keys=KEYS) -> DataFrame:
    """keys, depth, coder, bytes, error (sum of squares over all pixels), psnr (infinite without error) of every encoding.

    Values come back as floor(255 * kept / greatest kept). Null rows and rows without pixels count nothing; a page of
    nothing else has 0 bytes and a null psnr.
    """
    depth = F.col("depth")
    kept = F.transform("row", lambda v: F.floor(v / F.pow(F.lit(2), 8 - depth)).cast("int"))
    r = rows.select(*keys, F.coalesce("row", F.array().cast("array<int>")).alias("row"), F.explode(F.array(*map(F.lit, DEPTHS))).alias("depth")).withColumn("kept", kept)
    begins = F.filter(F.transform("kept", lambda k, x: (x % RUN == 0) | (k != F.get("kept", x - 1))), lambda new: new)
    lost = F.zip_with("row", "kept", lambda v, k: v - F.floor(k * 255 / (F.pow(F.lit(2), depth) - 1)))
    error = F.aggregate(lost, F.lit(0).cast("long"), lambda total, d: total + (d * d).cast("long"))
    sums = r.groupBy(*keys, "depth").agg(F.sum(F.ceil(F.size("row") * depth / 8)).alias("packed"), F.sum(2 * F.size(begins)).cast("long").alias("runs"), F.sum(error).alias("error"), F.sum(F.size("row")).alias("n"))
    psnr = F.when(F.col("n") == 0, None).when(F.col("error") == 0, F.lit(float("inf"))).otherwise(F.round(10 * F.log10(F.lit(255.0 * 255.0) * F.col("n") / F.col("error")), 6))
    coders = F.explode(F.array(*[F.struct(F.lit(c).alias("coder"), F.col(c).alias("bytes")) for c in ("packed", "runs")])).alias("c")
    return sums.withColumn("psnr", psnr).select(*keys, "depth", coders, "error", "psnr").select(*keys, "depth", "c.coder", "c.bytes", "error", "psnr")


def unbeaten(found: DataFrame, keys=KEYS) -> DataFrame:
    """The rows of found that no other row of their keys beats: none is as small with a smaller error, or smaller with the same.

    From the smallest on, a row stays if its error is below all before it. Of rows alike in both the first by coder and
    depth stays.
    """
    order = Window.partitionBy(*keys).orderBy("bytes", "error", "coder", "depth")
    best = F.min("error").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("__q_best", best).where(F.col("__q_best").isNull() | (F.col("error") < F.col("__q_best"))).drop("__q_best")


def least_within(found: DataFrame, psnr: float, keys=KEYS) -> DataFrame:
    """Of each page the smallest encoding with so great a psnr; none if there is none."""
    good = found.where(F.col("psnr") >= psnr).groupBy(*keys).agg(F.min(F.struct("bytes", "error", "coder", "depth", "psnr")).alias("b"))
    return good.select(*keys, "b.depth", "b.coder", "b.bytes", "b.error", "b.psnr")
