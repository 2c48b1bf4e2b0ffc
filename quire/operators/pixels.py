"""Measures of page rasters.

A raster has a row for each pixel: page, y, x, v, or r, g, b; keys names what tells pages apart. Whatever needs order
statistics works on the histogram, at most 256 rows a page, so no window holds a page's pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("page",)
#: What a count of report() is of: gray values, bins of the Laplacian, gray values of a tile.
GRAY, LAPLACIAN, TILE = 0, 1, 2


def share(condition: Column) -> Column:
    return F.sum(condition.cast("long")) / F.count("*")


def histogram(raster: DataFrame, keys=KEYS) -> DataFrame:
    return raster.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def cumulated(hist: DataFrame, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys)
    return hist.withColumns({"acc": F.sum("n").over(w.orderBy("v")), "tot": F.sum("n").over(w), "down": F.sum("n").over(w.orderBy(F.desc("v")))})


def percentile_of(p: float) -> Column:
    """Over cumulated rows: the least v up to which at least trunc(total * p) pixels lie; 0 if that is none."""
    target = F.floor(F.col("tot") * p)
    return F.when(F.max(target) == 0, 0).otherwise(F.min(F.when(F.col("acc") >= target, F.col("v"))))


def contrast(hist: DataFrame, keys=KEYS) -> DataFrame:
    out = cumulated(hist, keys).groupBy(*keys).agg(percentile_of(0.1).alias("p10"), percentile_of(0.9).alias("p90"))
    return out.withColumn("contrast", F.col("p90") - F.col("p10"))


def paper_level(hist: DataFrame, keys=KEYS) -> DataFrame:
    """The greatest v from which up at least total - trunc(0.8 * total) pixels lie."""
    return cumulated(hist, keys).groupBy(*keys).agg(F.max(F.when(F.col("down") >= F.col("tot") - F.floor(F.col("tot") * 0.8), F.col("v"))).alias("paper_level"))


def mean(hist: DataFrame, keys=KEYS) -> DataFrame:
    return hist.groupBy(*keys).agg(F.coalesce(F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.lit(255.0)).alias("mean"))


def otsu(hist: DataFrame, keys=KEYS) -> DataFrame:
    """Threshold of the greatest variance between classes, the lowest of equal ones, 128 if no split has two sides; ink: share up to it."""
    c = cumulated(hist, keys)
    w = Window.partitionBy(*keys)
    below = F.sum(F.col("v") * F.col("n")).over(w.orderBy("v"))
    c = c.withColumns({"sb": below, "sa": F.sum(F.col("v") * F.col("n")).over(w)})
    wb, wf = F.col("acc").cast("double"), (F.col("tot") - F.col("acc")).cast("double")
    gap = F.col("sb") / wb - (F.col("sa") - F.col("sb")) / wf
    c = c.withColumn("between", F.when(wf > 0, wb * wf * gap * gap))
    best = F.max(F.when(F.col("between") > 0, F.struct("between", (-F.col("v")).alias("m"), "acc")))
    return c.groupBy(*keys).agg(best.alias("b"), F.max("tot").alias("tot"), F.max(F.when(F.col("v") <= 128, F.col("acc"))).alias("at128")).select(
        *keys, F.coalesce(-F.col("b.m"), F.lit(128)).cast("int").alias("threshold"), (F.coalesce(F.col("b.acc"), F.col("at128"), F.lit(0)) / F.col("tot")).alias("ink")
    )


def laplacian(raster: DataFrame, keys=KEYS) -> DataFrame:
    """Four-neighbour Laplacian of inner pixels: the sum of neighbours less four times the pixel, by windows along rows and columns."""
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    r = raster.withColumns({"l": F.lag("v").over(across), "r": F.lead("v").over(across)})
    r = r.withColumns({"u": F.lag("v").over(down), "d": F.lead("v").over(down)}).where("l is not null and r is not null and u is not null and d is not null")
    return r.withColumn("lap", F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("v"))


def noise(raster: DataFrame, keys=KEYS) -> DataFrame:
    """Median of abs(Laplacian) div 4, capped at 255: the first bin with at least half the pixels; over 12, at most 1. Of pixels, or of rows of them (y, row)."""
    if "row" in raster.columns:
        return report(raster, keys=keys, kinds=(LAPLACIAN,)).select(*keys, "noise")
    bins = laplacian(raster, keys).select(*keys, F.least(F.lit(255), F.floor(F.abs("lap") / 4)).cast("int").alias("v"))
    c = cumulated(histogram(bins, keys), keys)
    i = F.min(F.when(F.col("acc") >= F.floor(F.col("tot") / 2), F.col("v")))
    return c.groupBy(*keys).agg(F.least(F.lit(1.0), i / 12.0).alias("noise"))


def laplacian_variance(raster: DataFrame, keys=KEYS) -> DataFrame:
    lap = F.col("lap").cast("long")
    laps = _framed(raster, keys).select(*keys, F.explode("lap").alias("lap")) if "row" in raster.columns else laplacian(raster, keys)
    got = laps.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(lap).alias("s"), F.sum(lap * lap).alias("q"))
    mean_ = F.col("s") / F.col("n")
    return got.select(*keys, F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean_ * mean_).alias("laplacian_variance"))


def row_means(raster: DataFrame, keys=KEYS) -> DataFrame:
    return raster.groupBy(*keys, "y").agg((F.sum("v") / F.count("*")).alias("row_mean"))


def row_score(raster: DataFrame, keys=KEYS) -> DataFrame:
    """Sum of squared differences of neighbouring row means over the rows; 0 for two rows or fewer. Means are in 1/65536."""
    scaled = raster.groupBy(*keys, "y").agg(F.floor(F.sum("v") * 65536 / F.count("*")).alias("m"))
    d = scaled.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy(*keys).orderBy("y")))
    got = d.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.col("d") * F.col("d")).alias("s"))
    return got.select(*keys, F.when(F.col("rows") <= 2, 0.0).otherwise(F.coalesce(F.col("s"), F.lit(0)) / F.lit(65536.0 * 65536.0) / F.col("rows")).alias("row_score"))


def tiles(raster: DataFrame, grid: int, keys=KEYS) -> DataFrame:
    """Each pixel with the tiles that hold it; where a page has fewer lines than the grid, tiles overlap.

    A tile's lines begin at g * n div grid, so a line's tiles are found by arithmetic; pixels meet only their page's size.
    """
    size = raster.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    out = raster.join(size, list(keys))
    for axis, n, g in (("y", "h", "gy"), ("x", "w", "gx")):
        at, many = F.col(axis), F.col(n)
        lo = F.greatest(F.lit(0), F.floor(at * grid / many).cast("int") - 1)
        hi = F.least(F.lit(grid - 1), F.floor((at + 1) * grid / many).cast("int") + 1)

        begin = lambda k, many=many: F.floor(k * many / grid)
        holds = lambda k: (F.col(axis) >= begin(k)) & (F.col(axis) < F.greatest(begin(k) + 1, begin(k + 1)))  # noqa: E731, B023
        out = out.withColumn(g, F.explode(F.filter(F.sequence(lo, hi), holds)))
    return out.drop("h", "w")


def unevenness(raster: DataFrame, grid: int = 12, keys=KEYS) -> DataFrame:
    """Spread of the tiles' paper levels: of each tile the mean of pixels from its 80th percentile up; over the sorted levels (high - low) / high. Of pixels, or of rows of them (y, row)."""
    if "row" in raster.columns:
        return report(raster, grid, keys, (TILE,)).select(*keys, "unevenness")
    by = [*keys, "gy", "gx"]
    c = cumulated(histogram(tiles(raster, grid, keys), by), by)
    cut = c.groupBy(*by).agg(percentile_of(0.8).alias("cut"))
    level = c.join(cut, by).where(F.col("v") >= F.col("cut")).groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("level"))
    s = level.groupBy(*keys).agg(F.array_sort(F.collect_list("level")).alias("s"))
    n = F.size("s")
    lo, hi = F.get("s", F.floor(n * 0.1).cast("int")), F.get("s", F.least(n - 1, F.floor(n * 0.9).cast("int")))
    return s.select(*keys, F.when((n < 4) | (hi <= 1), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - lo) / hi))).alias("unevenness"))


def box_sums(raster: DataFrame, radius: int, keys=KEYS) -> DataFrame:
    """Sum and number of the pixels within radius in both directions, cut at the edges: down, then across."""
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-radius, radius)
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-radius, radius)
    r = raster.withColumns({"s1": F.sum("v").over(down), "n1": F.count("*").over(down)})
    return r.withColumns({"box_sum": F.sum("s1").over(across), "box_n": F.sum("n1").over(across)}).drop("s1", "n1")


def binarize(raster: DataFrame, width: int, beta: float = 0.90, keys=KEYS) -> DataFrame:
    window = max(9, (width // 110) | 1)
    r = box_sums(raster, max(1, window // 2), keys)
    return r.withColumn("bit", F.when(F.col("v") < F.col("box_sum") / F.col("box_n") * beta, 0).otherwise(255)).drop("box_sum", "box_n")


def median(raster: DataFrame, keys=KEYS) -> DataFrame:
    """Median of the nine pixels around each inner one."""
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    three = lambda w, c: F.array(F.lag(c).over(w), F.col(c), F.lead(c).over(w))
    r = raster.withColumn("row3", three(across, "v"))
    r = r.withColumn("nine", F.flatten(three(down, "row3"))).where(F.size("nine") == 9)
    whole = r.where(~F.exists("nine", lambda x: x.isNull()))
    return whole.select(*keys, "y", "x", F.get(F.array_sort("nine"), 4).alias("median"))


def color_shares(rgb: DataFrame, keys=KEYS) -> DataFrame:
    """has_color, gray_only and the greatest spread of the channels."""
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    lit = hi > 60
    strong = lit & ((hi - lo) / hi > 0.22)
    got = rgb.groupBy(*keys).agg(
        F.sum(strong.cast("long")).alias("strong"), F.sum(lit.cast("long")).alias("lit"), share(hi - lo > 16).alias("wide"), F.max(hi - lo).alias("channel_spread")
    )
    return got.select(*keys, F.coalesce(F.col("strong") / F.nullif(F.col("lit"), F.lit(0)) > 0.006, F.lit(False)).alias("has_color"), (F.col("wide") < 0.005).alias("gray_only"), "channel_spread")


def luma(rgb: DataFrame) -> DataFrame:
    """v by integer weights of the channels."""
    return rgb.withColumn("v", F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000).cast("int"))


def mono_like(raster: DataFrame, keys=KEYS) -> DataFrame:
    mid = raster.groupBy(*keys).agg(share((F.col("v") > 60) & (F.col("v") < 195)).alias("mid"))
    return otsu(histogram(raster, keys), keys).join(mid, list(keys)).select(*keys, ((F.col("ink") > 0.002) & (F.col("ink") < 0.6) & (F.col("mid") < 0.12)).alias("mono_like"))


def quadrant(raster: DataFrame, dark: int = 128, least: int = 50, keys=KEYS) -> DataFrame:
    """Which quarter holds most dark pixels, the first of equal ones; none under least."""
    size = raster.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    r = raster.join(size, list(keys)).where(F.col("v") < dark)
    q = F.when(F.col("y") * 2 < F.col("h"), 0).otherwise(2) + F.when(F.col("x") * 2 < F.col("w"), 0).otherwise(1)
    counts = r.withColumn("q", q).groupBy(*keys).agg(*[F.sum((F.col("q") == i).cast("long")).alias(f"q{i}") for i in range(4)])
    best = F.greatest("q0", "q1", "q2", "q3")
    where = F.array_position(F.array("q0", "q1", "q2", "q3"), best) - 1
    return size.select(*keys).join(counts, list(keys), "left").select(*keys, F.when(best >= least, F.get(F.array(*map(F.lit, ("top-left", "top-right", "bottom-left", "bottom-right"))), where.cast("int"))).otherwise("none").alias("quadrant"))


def border_trim(raster: DataFrame, paperish: float = 240.0, most: float = 0.02, keys=KEYS) -> DataFrame:
    """Lines at each edge whose mean is below paperish, from the edge inwards without a gap, at most a share of the page and one at least."""
    size = raster.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    out = size
    for axis, n, sides in (("y", "h", ("top", "bottom")), ("x", "w", ("left", "right"))):
        lines = raster.groupBy(*keys, axis).agg((F.sum("v") / F.count("*") < paperish).alias("dirty")).join(size, list(keys))
        cap = F.greatest(F.lit(1), F.floor(F.col(n) * most))
        clean = lines.groupBy(*keys).agg(
            F.max(cap).alias("cap"), F.coalesce(F.min(F.when(~F.col("dirty"), F.col(axis))), F.max(n)).alias("a"), F.coalesce(F.max(n) - 1 - F.max(F.when(~F.col("dirty"), F.col(axis))), F.max(n)).alias("z")
        )
        out = out.join(clean.select(*keys, F.least("cap", "a").cast("int").alias(sides[0]), F.least("cap", "z").cast("int").alias(sides[1])), list(keys))
    return out.select(*keys, "top", "bottom", "left", "right")


def stretch(raster: DataFrame, keys=KEYS) -> DataFrame:
    """Contrast stretched between the 2nd and 98th percentile, rounded and clamped; null where they are closer than 18."""
    ends = cumulated(histogram(raster, keys), keys).groupBy(*keys).agg(percentile_of(0.02).alias("lo"), percentile_of(0.98).alias("hi"))
    v = F.round((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))
    return raster.join(ends, list(keys)).select(*keys, "y", "x", F.when(F.col("hi") - F.col("lo") >= 18, F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int").alias("v"))


def tile_levels(rgb: DataFrame, grid: int = 24, keys=KEYS) -> DataFrame:
    """Mean of each channel over a tile's pixels from the 85th percentile of gray up; an empty tile is white."""
    by = [*keys, "gy", "gx"]
    t = tiles(luma(rgb), grid, keys)
    cut = cumulated(histogram(t, by), by).groupBy(*by).agg(percentile_of(0.85).alias("cut"))
    return t.join(cut, by).groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("v") >= F.col("cut"), F.col(c))) / F.count(F.when(F.col("v") >= F.col("cut"), 1)), F.lit(255.0)).alias(f"level_{c}") for c in "rgb"])


def background(rgb: DataFrame, strength: float, grid: int = 24, keys=KEYS) -> DataFrame:
    """Each channel brought to the mark by the tiles' levels around the pixel, interpolated in both directions."""
    if strength <= 0.001:
        return rgb
    mark = 245.0 + 10.0 * strength
    levels = tile_levels(rgb, grid, keys)
    size = rgb.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    r = rgb.join(size, list(keys))
    last = grid - 1
    for axis, n, g in (("y", "h", "gy"), ("x", "w", "gx")):
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), (F.col(axis) + 0.5) * grid / F.col(n) - 0.5))
        r = r.withColumns({f"{g}0": F.floor(at).cast("int"), f"{g}1": F.least(F.lit(last), F.floor(at).cast("int") + 1), f"{g}f": at - F.floor(at)})
    for a in "01":
        for b in "01":
            side = levels.select(*keys, F.col("gy").alias(f"gy{a}"), F.col("gx").alias(f"gx{b}"), *[F.col(f"level_{c}").alias(f"l{a}{b}{c}") for c in "rgb"])
            r = r.join(side, [*keys, f"gy{a}", f"gx{b}"])
    out = [*keys, "y", "x"]
    for c in "rgb":
        upper = F.col(f"l00{c}") * (1 - F.col("gxf")) + F.col(f"l01{c}") * F.col("gxf")
        lower = F.col(f"l10{c}") * (1 - F.col("gxf")) + F.col(f"l11{c}") * F.col("gxf")
        level = upper * (1 - F.col("gyf")) + lower * F.col("gyf")
        factor = F.greatest(F.lit(1 - 0.18 * strength), F.least(F.lit(3.0), mark / F.greatest(F.lit(1.0), level)))
        out.append(F.least(F.lit(255.0), F.round(F.col(c) * factor)).cast("int").alias(c))
    return r.select(*out)


def compare(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Mean absolute difference and PSNR (infinite without any) of two rasters of the same pages."""
    d = a.join(b.withColumnRenamed("v", "u"), [*keys, "y", "x"]).withColumn("d", (F.col("v") - F.col("u")).cast("long"))
    got = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.abs("d")).alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    mse = F.col("q") / F.col("n")
    return got.select(*keys, (F.col("s") / F.col("n")).alias("pixel_diff"), F.when(F.col("q") == 0, F.lit(float("inf"))).otherwise(F.round(10 * F.log10(F.lit(255.0 * 255.0) / mse), 6)).alias("psnr"))


def ssim(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Mean over whole blocks of 8 by 8."""
    j = a.join(b.withColumnRenamed("v", "u"), [*keys, "y", "x"]).withColumns({"v": F.col("v").cast("long"), "u": F.col("u").cast("long")})
    g = j.groupBy(*keys, F.floor(F.col("y") / 8).alias("by"), F.floor(F.col("x") / 8).alias("bx")).agg(
        F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sa", F.col("v")), ("sb", F.col("u")), ("aa", F.col("v") * F.col("v")), ("bb", F.col("u") * F.col("u")), ("ab", F.col("v") * F.col("u")))]
    ).where("n = 64")
    ma, mb = F.col("sa") / 64.0, F.col("sb") / 64.0
    va, vb, cov = F.col("aa") / 64.0 - ma * ma, F.col("bb") / 64.0 - mb * mb, F.col("ab") / 64.0 - ma * mb
    c1, c2 = F.lit(6.5025), F.lit(58.5225)
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return g.groupBy(*keys).agg(F.round(F.avg(F.round(s, 9)), 6).alias("ssim"))


def filtered(raster: DataFrame, keys=KEYS) -> DataFrame:
    """The five row filters of each byte, modulo 256, as an array by type."""
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    r = raster.withColumns({"a": F.coalesce(F.lag("v").over(across), F.lit(0)), "b": F.coalesce(F.lag("v").over(down), F.lit(0))})
    r = r.withColumn("c", F.coalesce(F.lag("b").over(across), F.lit(0)))
    p = F.col("a") + F.col("b") - F.col("c")
    pa, pb, pc = F.abs(p - F.col("a")), F.abs(p - F.col("b")), F.abs(p - F.col("c"))
    paeth = F.when((pa <= pb) & (pa <= pc), F.col("a")).when(pb <= pc, F.col("b")).otherwise(F.col("c"))
    predictions = [F.lit(0), F.col("a"), F.col("b"), F.floor((F.col("a") + F.col("b")) / 2).cast("int"), paeth]
    return r.select(*keys, "y", "x", *[F.pmod(F.col("v") - e, F.lit(256)).alias(f"f{i}") for i, e in enumerate(predictions)])


def best_filter(rows: DataFrame, keys=KEYS) -> DataFrame:
    """For each row of pixels (y, row, an array) the filter of the least sum of absolute signed bytes, the lowest type of equal ones."""
    r = rows.withColumn("up", F.lag("row").over(Window.partitionBy(*keys).orderBy("y")))

    def predictions(i: Column) -> list[Column]:
        # to the left of the first pixel, and above the first row, there is 0
        a, b, c = (F.coalesce(F.get(F.col(n), j), F.lit(0)) for n, j in (("row", i - 1), ("up", i), ("up", i - 1)))
        p = a + b - c
        pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
        return [F.lit(0), a, b, F.floor((a + b) / 2).cast("int"), F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)]

    def signed(i: Column, kind: int) -> Column:
        f = F.pmod(F.get("row", i) - predictions(i)[kind], F.lit(256))
        return F.when(f < 128, f).otherwise(256 - f).cast("long")

    def summed(kind: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size("row") - 1), F.lit(0).cast("long"), lambda total, i: total + signed(i, kind))

    sums = [summed(k) for k in range(5)]
    best = F.array_min(F.array(*[F.struct(e.alias("score"), F.lit(k).alias("filter")) for k, e in enumerate(sums)]))
    return r.where(F.size("row") > 0).select(*keys, "y", best["filter"].alias("filter"), best["score"].alias("score"))


def packed(raster: DataFrame, threshold: int = 128, white_pad: bool = True, keys=KEYS) -> DataFrame:
    """Bytes of a 1-bit plane, first pixel highest: 1 is white and so are missing bits, or 1 is ink and they are not."""
    bit = (F.col("v") > threshold) if white_pad else (F.col("v") <= threshold)
    g = raster.groupBy(*keys, "y", F.floor(F.col("x") / 8).alias("byte")).agg(F.sum(F.when(bit, F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), 7 - F.col("x") % 8)).otherwise(0)).alias("s"), F.count("*").alias("n"))
    pad = F.pow(F.lit(2.0), 8 - F.col("n")) - 1 if white_pad else F.lit(0.0)
    return g.select(*keys, "y", "byte", (F.col("s") + pad).cast("int").alias("value"))


def ink_color(rgb: DataFrame, keys=KEYS) -> DataFrame:
    """Mean of each channel over pixels up to the threshold of gray, darkened; 0 without ink."""
    g = luma(rgb)
    t = otsu(histogram(g, keys), keys)
    d = g.join(t, list(keys)).where(F.col("v") <= F.col("threshold"))
    got = d.groupBy(*keys).agg(*[F.least(F.lit(0.35), F.sum(c) / F.count("*") / 255 * 0.85).alias(f"ink_{c}") for c in "rgb"])
    return t.select(*keys).join(got, list(keys), "left").select(*keys, *[F.coalesce(f"ink_{c}", F.lit(0.0)).alias(f"ink_{c}") for c in "rgb"])


def boundary_contrast(raster: DataFrame, quads: DataFrame, keys=KEYS) -> DataFrame:
    """Mean inside a box (its middle three fifths) and the brightest of the strips around it; null with fewer than two strips."""
    size = raster.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    q = quads.join(size, list(keys))
    i = lambda e: e.cast("int")
    q = q.withColumns({"bx0": F.greatest(F.lit(0), i(F.col("qx0") * F.col("w"))), "bx1": F.least(F.col("w") - 1, i(F.col("qx1") * F.col("w"))), "by0": F.greatest(F.lit(0), i(F.col("qy0") * F.col("h"))), "by1": F.least(F.col("h") - 1, i(F.col("qy1") * F.col("h")))})
    q = q.where("bx1 > bx0 + 2 and by1 > by0 + 2").withColumn("band", F.greatest(F.lit(2), i(F.least("w", "h") * 0.02)))
    fx, fy = i(F.floor((F.col("bx1") - F.col("bx0")) / 5)), i(F.floor((F.col("by1") - F.col("by0")) / 5))
    areas = [
        ("bx0", "bx1", F.col("by0") - F.col("band"), F.col("by0") - 1),
        ("bx0", "bx1", F.col("by1") + 1, F.col("by1") + F.col("band")),
        (F.col("bx0") - F.col("band"), F.col("bx0") - 1, "by0", "by1"),
        (F.col("bx1") + 1, F.col("bx1") + F.col("band"), "by0", "by1"),
        (F.col("bx0") + fx, F.col("bx1") - fx, F.col("by0") + fy, F.col("by1") - fy),
    ]
    r = raster.join(q, list(keys))
    aggregates = []
    for n, (x0, x1, y0, y1) in enumerate(areas):
        x0, x1, y0, y1 = (F.col(e) if isinstance(e, str) else e for e in (x0, x1, y0, y1))
        sx0, sx1 = F.greatest(F.lit(0), x0), F.least(F.col("w") - 1, x1)
        sy0, sy1 = F.greatest(F.lit(0), y0), F.least(F.col("h") - 1, y1)
        here = (sx1 > sx0) & (sy1 > sy0) & F.col("x").between(sx0, sx1) & F.col("y").between(sy0, sy1)
        aggregates.append((F.sum(F.when(here, F.col("v"))) / F.count(F.when(here, 1))).alias(f"m{n}"))
    g = r.groupBy(*keys).agg(*aggregates)
    strips = sum((F.col(f"m{n}").isNotNull().cast("int") for n in range(1, 4)), F.col("m0").isNotNull().cast("int"))
    ok = (strips >= 2) & F.col("m4").isNotNull()
    return size.select(*keys).join(g, list(keys), "left").select(*keys, F.when(ok, F.col("m4")).alias("inside"), F.when(ok, F.greatest("m0", "m1", "m2", "m3")).alias("outside"))


def _framed(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of pixels (y, row) with the rows above and below, their number h and length w, and lap, the Laplacian of their inner pixels, empty in the outer rows."""
    page = Window.partitionBy(*keys)
    r = rows.withColumns({"up": F.lag("row").over(page.orderBy("y")), "down": F.lead("row").over(page.orderBy("y")), "h": F.count("*").over(page).cast("int"), "w": F.size("row")})
    at = lambda name, i: F.get(F.col(name), i)
    lap = F.transform(F.sequence(F.lit(1), F.col("w") - 2), lambda i: at("row", i - 1) + at("row", i + 1) + at("up", i) + at("down", i) - 4 * at("row", i))
    return r.withColumn("lap", F.when(F.col("up").isNotNull() & F.col("down").isNotNull() & (F.col("w") > 2), lap).otherwise(F.array().cast("array<int>"))).drop("up", "down")


def _counts(rows: DataFrame, grid: int, keys=KEYS, kinds=(GRAY, LAPLACIAN, TILE)) -> DataFrame:
    """Counts of values by kind, gy, gx, v, from rows of pixels (y, row), a row of pixels being an array."""
    r = _framed(rows, keys)

    def held(at: Column, n: Column) -> Column:
        """Tiles that hold a line."""
        begin = lambda k: F.floor(k * n / grid)
        near = F.sequence(F.greatest(F.lit(0), F.floor(at * grid / n).cast("int") - 1), F.least(F.lit(grid - 1), F.floor((at + 1) * grid / n).cast("int") + 1))
        return F.filter(near, lambda k: (at >= begin(k)) & (at < F.greatest(begin(k) + 1, begin(k + 1))))

    def value(kind: int, gy, gx, v) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(gy).cast("int").alias("gy"), F.lit(gx).cast("int").alias("gx"), v.cast("int").alias("v"))

    across = lambda v, x: F.transform(held(x, F.col("w")), lambda gx: F.struct(gx.alias("gx"), v.alias("v")))
    parts = {
        GRAY: F.transform("row", lambda v: value(GRAY, -1, -1, v)),
        LAPLACIAN: F.transform("lap", lambda x: value(LAPLACIAN, -1, -1, F.least(F.lit(255), F.floor(F.abs(x) / 4)))),
        TILE: F.flatten(F.transform(held(F.col("y"), F.col("h")), lambda gy: F.transform(F.col("tiled"), lambda t: value(TILE, gy, t["gx"], t["v"])))),
    }
    if TILE in kinds:
        r = r.withColumn("tiled", F.flatten(F.transform("row", across)))
    r = r.select(*keys, F.explode(F.concat(*[parts[k] for k in kinds])).alias("c"))
    return r.groupBy(*keys, "c.kind", "c.gy", "c.gx", "c.v").agg(F.count("*").alias("n"))


def report(rows: DataFrame, grid: int = 12, keys=KEYS, kinds=(GRAY, LAPLACIAN, TILE)) -> DataFrame:
    """Paper level, percentiles, mean, Otsu threshold and ink, noise, unevenness, mono_like of pages, in one pass over rows of pixels (y, row).

    Rows of a page come together once, as arrays; all that follows works on counts in the same place. kinds: what is
    counted; what needs others is null, or 0 for noise and unevenness.
    """
    by = [*keys, "kind", "gy", "gx"]
    w = Window.partitionBy(*by)
    up, down, v, n = w.orderBy("v"), w.orderBy(F.desc("v")), F.col("v"), F.col("n")
    c = _counts(rows, grid, keys, kinds).withColumns(
        {"acc": F.sum("n").over(up), "down": F.sum("n").over(down), "tot": F.sum("n").over(w), "sb": F.sum(v * n).over(up), "sdown": F.sum(v * n).over(down), "sa": F.sum(v * n).over(w)}
    )
    wb, wf = F.col("acc"), F.col("tot") - F.col("acc")
    gap = F.col("sb") / wb - (F.col("sa") - F.col("sb")) / wf
    c = c.withColumn("between", F.when(wf > 0, wb * wf * gap * gap))
    reach = F.when(F.col("acc") >= F.floor(F.col("tot") * 0.8), F.struct("v", "down", "sdown"))
    whole = F.floor(F.col("tot") * 0.8) == 0
    groups = c.groupBy(*by).agg(
        percentile_of(0.1).alias("p10"),
        percentile_of(0.9).alias("p90"),
        F.max(F.when(F.col("down") >= F.col("tot") - F.floor(F.col("tot") * 0.8), v)).alias("paper_level"),
        (F.sum(v * n) / F.sum("n")).alias("mean"),
        F.max(F.when(F.col("between") > 0, F.struct("between", (-v).alias("m"), "acc"))).alias("best"),
        F.max(F.when(v <= 128, F.col("acc"))).alias("at128"),
        F.max("tot").alias("tot"),
        F.sum(F.when((v > 60) & (v < 195), n).otherwise(0)).alias("mid"),
        F.min(F.when(F.col("acc") >= F.floor(F.col("tot") / 2), v)).alias("middle"),
        F.min(reach).alias("cut"),
        F.max(whole).alias("few"),
    )
    of = lambda kind, e: F.when(F.col("kind") == kind, e)
    level = F.when(F.col("few"), F.col("mean")).otherwise(F.col("cut.sdown") / F.col("cut.down"))
    one = [F.max(of(GRAY, F.col(x))).alias(x) for x in ("p10", "p90", "paper_level", "mean")]
    ink = F.coalesce(F.col("best.acc"), F.col("at128"), F.lit(0)) / F.col("tot")
    got = groups.groupBy(*keys).agg(
        *one,
        F.max(of(GRAY, F.coalesce(-F.col("best.m"), F.lit(128)))).cast("int").alias("threshold"),
        F.max(of(GRAY, ink)).alias("ink"),
        F.max(of(GRAY, F.col("mid") / F.col("tot"))).alias("mid"),
        F.max(of(LAPLACIAN, F.least(F.lit(1.0), F.col("middle") / 12.0))).alias("noise"),
        F.array_sort(F.collect_list(of(TILE, level))).alias("s"),
    )
    k = F.size("s")
    lo, hi = F.get("s", F.floor(k * 0.1).cast("int")), F.get("s", F.least(k - 1, F.floor(k * 0.9).cast("int")))
    uneven = F.when((k < 4) | (hi <= 1), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - lo) / hi)))
    mono = (F.col("ink") > 0.002) & (F.col("ink") < 0.6) & (F.col("mid") < 0.12)
    return got.select(*keys, "paper_level", "p10", "p90", (F.col("p90") - F.col("p10")).alias("contrast"), "mean", "threshold", "ink", F.coalesce("noise", F.lit(0.0)).alias("noise"), uneven.alias("unevenness"), mono.alias("mono_like"))
