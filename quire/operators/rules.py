"""Page and document decisions as column rules, and the roll-up of pages into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(e: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), e))


def proc_dpi(dpi: Column) -> Column:
    return F.when(dpi <= 0, 300).otherwise(F.greatest(F.lit(150), F.least(F.lit(300), dpi))).cast("int")


def page_pixels(points: Column, dpi: Column) -> Column:
    """Rendered pixels of a length in points, one at least."""
    return F.greatest(F.lit(1), F.round(points * dpi / 72.0).cast("int"))


def page_size(width: Column, height: Column, rotate: Column, dpi: Column) -> tuple[Column, Column]:
    """Rendered width and height of a page of so many points; a quarter turn swaps them."""
    turned = F.pmod(rotate, F.lit(180)) == 90
    w, h = page_pixels(width, dpi), page_pixels(height, dpi)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def is_lossless(encoder: Column) -> Column:
    return encoder.isin("zip", "jp2lossless")


def effective_mode(adaptive: Column, mode: Column, has_color: Column, mono_like: Column, lossless: Column) -> Column:
    """Mode of a page: picked where adaptive or auto (mono only if not lossless), else the one asked for; an unknown one is color."""
    auto = adaptive | (mode == "auto")
    picked = F.when(has_color, "color").when(mono_like & ~lossless, "mono").otherwise("gray")
    return F.when(auto, picked).when(mode.isin("color", "gray", "mono"), mode).otherwise("color")


def paper_white(paper_level: Column, mean: Column) -> Column:
    return (paper_level >= 249) & (mean >= 250)


def needs_clean(unevenness: Column, white: Column) -> Column:
    return (unevenness > 0.05) | ~white


def accept_binary(ink: Column) -> Column:
    return (ink > 0.0004) & (ink < 0.45)


def content_guard(old: Column, new: Column) -> Column:
    """Which version stays by contrast: filtered or original; a null new one is a filter without result."""
    return F.when(new.isNull(), "original").when((old <= 20) | (new >= 0.6 * old), "filtered").otherwise("original")


def bg_strength(unevenness: Column, paper: Column) -> Column:
    return clamp(F.greatest(clamp((unevenness - 0.05) / 0.15, 0.0, 1.0) * 0.55, clamp((250.0 - paper) / 14.0, 0.0, 1.0) * 0.70), 0.0, 1.0)


def uses_strength(preset: Column, bg_remove: Column) -> Column:
    return F.when(preset.isNull(), F.coalesce(bg_remove, F.lit(False))).otherwise(~preset.isin("bw", "original"))


def quality_map(quality: Column) -> tuple[Column, Column]:
    """Of an encoder, and of a layered page's background."""
    return clamp(quality / 100.0, 0.1, 0.98), clamp(quality / 100.0 - 0.22, 0.30, 0.85)


def noise_bucket(noise: Column) -> Column:
    return F.when(noise < 0.22, "low").when(noise < 0.5, "mid").otherwise("high")


def prefix(pages: DataFrame, k: int, doc: str = "doc", page_no: str = "page_no") -> DataFrame:
    """The first k pages of each document."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(page_no))).where(F.col("_n") <= k).drop("_n")


def doc_report(pages: DataFrame, sampled: int = 6, keys: DataFrame | None = None) -> DataFrame:
    """Documents from doc, page_no, mode, skew, noise, unevenness, paper of their first pages.

    keys: doc of every page, where pages holds but the first ones; page_count counts those. The mode is color if any page is, else gray if any, else mono; the skew is the signed one of the greatest size,
    of equal ones the first page's; the rest are means.
    """
    p = prefix(pages, sampled)
    g = p.groupBy("doc").agg(
        F.count("*").alias("sampled"),
        F.when(F.bool_or(F.col("mode") == "color"), "color").when(F.bool_or(F.col("mode") == "gray"), "gray").otherwise("mono").alias("color_mode"),
        F.max_by("skew", F.struct(F.abs("skew"), -F.col("page_no"))).alias("skew_angle"),
        *[F.round(F.avg(c), 6).alias(n) for c, n in (("noise", "noise_level"), ("unevenness", "bg_unevenness"), ("paper", "paper_white"))],
        F.transform(F.array_sort(F.collect_list(F.when(F.abs("skew") > 0.3, F.col("page_no")))), lambda x: x.cast("string")).alias("skewed"),
    )
    count = (pages if keys is None else keys).groupBy("doc").agg(F.count("*").alias("page_count"))
    return g.join(count, "doc")


def recommend(report: DataFrame, has_text: Column) -> DataFrame:
    """The processing a report asks for."""
    mode = F.col("color_mode")
    preset = F.when(mode == "color", "color").when(mode == "mono", "bw").otherwise("auto")
    tilted = F.abs("skew_angle") > 0.3
    pages = F.when(~tilted, "").when(F.size("skewed") <= 3, F.array_join("skewed", ",")).otherwise(F.size("skewed").cast("string"))
    return report.select(
        "doc",
        (~has_text).alias("ocr_enabled"),
        has_text.alias("ocr_skip"),
        F.when(~has_text, "chi_sim+eng").alias("ocr_language"),
        F.when(~has_text, "searchable").alias("ocr_output"),
        preset.alias("preset"),
        tilted.alias("deskew"),
        (F.col("bg_unevenness") > 0.12).alias("bg_remove"),
        (F.col("noise_level") > 0.5).alias("descreen"),
        F.when(preset == "bw", 0.0).otherwise(1.0).alias("sharpen"),
        F.round(bg_strength(F.col("bg_unevenness"), F.col("paper_white")), 6).alias("bg_strength"),
        (mode != "mono").alias("adaptive"),
        F.when(mode == "mono", "mono").otherwise("auto").alias("compress_mode"),
        F.when(mode == "color", 72).otherwise(70).alias("quality"),
        F.lit("jpeg").alias("encoder"),
        F.lit("ccitt").alias("mono_encoder"),
        pages.alias("skew_pages"),
    )


#: Id, quality, adaptive, recommended of the three plans; high keeps the document's own mode.
PLANS = (("extreme", 50, True, False), ("balanced", 72, True, True), ("high", 90, False, False))


def plans(report: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("plan"), F.lit(q).alias("quality"), F.lit(a).alias("adaptive"), F.lit(r).alias("recommended")) for i, q, a, r in PLANS]))
    return report.select("doc", "color_mode", rows.alias("p")).select("doc", "p.*", F.when(F.col("p.adaptive"), "auto").otherwise(F.col("color_mode")).alias("mode"))


def override(recommended: DataFrame, plans_: DataFrame) -> DataFrame:
    """Recommendations whose compression is that of the first plan that is flagged as recommended, where there is one."""
    place = F.create_map(*[F.lit(x) for i, p in enumerate(PLANS) for x in (p[0], i)])
    chosen = plans_.where("recommended").groupBy("doc").agg(F.min_by(F.struct("adaptive", F.col("mode").alias("compress_mode"), "quality"), place[F.col("plan")]).alias("p"))
    out = recommended.join(chosen, "doc", "left")
    return out.withColumns({c: F.coalesce(F.col(f"p.{c}"), F.col(c)) for c in ("adaptive", "compress_mode", "quality")}).drop("p")


def progress(pages: DataFrame, doc: str = "doc", page_no: str = "page_no") -> DataFrame:
    """Pages with the share of their document that is done when they are."""
    w = Window.partitionBy(doc)
    return pages.withColumn("progress", F.row_number().over(w.orderBy(page_no)) / F.count("*").over(w))


def within_budget(sizes: DataFrame, budget: int, by: str = "doc", order: str = "page_no", size: str = "bytes") -> DataFrame:
    """The first rows of each group, as long as their sizes together stay within the budget."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def rate_distortion(results: DataFrame, by: list[str]) -> DataFrame:
    """Points of the encoders that lose something, in order of their bytes (ties: encoder, quality), with their place."""
    w = Window.partitionBy(*by).orderBy("bytes", "encoder", "quality")
    return results.where(~is_lossless(F.col("encoder"))).withColumn("place", F.row_number().over(w).cast("long"))


def size_estimate(pages: DataFrame, sampled: int = 4) -> DataFrame:
    """Bytes that a document will have, from those of its first pages, and what that saves."""
    s = prefix(pages, sampled).groupBy("doc").agg(F.sum("bytes").alias("sample"), F.count("*").alias("k"))
    t = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("bytes").alias("file_size"))
    est = F.greatest(F.lit(1), F.floor(F.col("sample") / F.col("k") * F.col("pages") + 2500.0 * F.col("pages")).cast("long"))
    return t.join(s, "doc", "left").withColumn("estimate", F.when(F.coalesce("k", F.lit(0)) == 0, F.lit(0)).otherwise(est).cast("long"))


def ratio(size: Column, estimate: Column) -> Column:
    return F.when(estimate == 0, 0.0).otherwise(size / estimate)


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((1 - after / before) * 100)


def convex(x: list[Column], y: list[Column]) -> Column:
    """Whether the corners in order turn one way; turns under 1e-6 do not count, and none at all is not convex."""
    turns = []
    for i in range(4):
        j, k = (i + 1) % 4, (i + 2) % 4
        turns.append((x[j] - x[i]) * (y[k] - y[j]) - (y[j] - y[i]) * (x[k] - x[j]))
    left = sum(((t >= 1e-6).cast("int") for t in turns), F.lit(0))
    right = sum(((t <= -1e-6).cast("int") for t in turns), F.lit(0))
    return ((left > 0) & (right == 0)) | ((right > 0) & (left == 0))


def shoelace(x: list[Column], y: list[Column]) -> Column:
    total = sum((x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)), F.lit(0.0))
    return F.least(F.lit(1.2), F.abs(total) / 2)


def crop_gate(quads: DataFrame) -> DataFrame:
    """The first gate that a quad fails, or applied: of id, four corners in 0..1, inside and outside brightness."""
    x, y = [F.col(f"x{i}") for i in range(4)], [F.col(f"y{i}") for i in range(4)]
    cx, cy = [clamp(e, 0.0, 1.0) for e in x], [clamp(e, 0.0, 1.0) for e in y]
    area = shoelace(x, y)
    wide, high = F.greatest(*cx) - F.least(*cx), F.greatest(*cy) - F.least(*cy)
    return quads.select(
        "id",
        convex(cx, cy).alias("is_convex"),
        F.round(area, 6).alias("coverage"),
        F.when(~convex(cx, cy), "distorted")
        .when(area >= 0.96, "full page")
        .when(area < 0.10, "too small")
        .when((wide < 0.25) | (high < 0.25), "too narrow")
        .when(F.col("inside").isNull() | F.col("outside").isNull(), "unmeasurable")
        .when(F.col("inside") - F.col("outside") <= 30, "paper outside")
        .otherwise("applied")
        .alias("gate"),
    )


def layered(layered_bytes: Column, flat_bytes: Column, adaptive: Column, lossless: Column, mode: Column) -> Column:
    """Whether a page is written in layers: allowed, and smaller by more than 4096 bytes."""
    return adaptive & ~lossless & (mode != "mono") & (layered_bytes + 4096 < flat_bytes)


#: Encoders in the order in which each is tried.
FALLBACKS = {"jpeg": ("jpeg", "zip"), "jp2": ("jp2", "jpeg", "zip"), "jp2lossless": ("jp2lossless", "zip"), "zip": ("zip",), "ccitt": ("ccitt", "flate")}


def encoder_used(asked: Column, available: Column) -> Column:
    """The first encoder of asked's chain that the array available holds; an unknown one asks for jpeg."""
    out = None
    for name, chain in FALLBACKS.items():
        pick = F.coalesce(*[F.when(F.array_contains(available, c), F.lit(c)) for c in chain], F.lit(chain[-1]))
        out = F.when(asked == name, pick) if out is None else out.when(asked == name, pick)
    chain = FALLBACKS["jpeg"]
    return out.otherwise(F.coalesce(*[F.when(F.array_contains(available, c), F.lit(c)) for c in chain], F.lit(chain[-1])))


def encoder_sizes(pages: DataFrame, encoders: list[tuple[str, float]]) -> list:
    """(bytes, encoder) of a row of pages (bytes, quality) by each of a few encoders (name, factor), by name."""
    size = lambda factor: F.floor(F.col("bytes") * F.lit(factor) * F.col("quality") / 100.0).cast("long")
    return [F.struct(size(factor).alias("bytes"), F.lit(name).alias("encoder")) for name, factor in sorted(encoders)]


def best_of_row(pages: DataFrame, encoders: list[tuple[str, float]]) -> DataFrame:
    """best_encoder() of pages (bytes, quality, others) whose rows are a group each: worked out in the row, so that nothing is moved or sorted."""
    names = [name for name, _ in sorted(encoders)]
    sizes = pages.withColumns({f"__q_{k}": x["bytes"] for k, x in enumerate(encoder_sizes(pages, encoders))})
    each = [F.col(f"__q_{k}") for k in range(len(names))]
    sizes = sizes.withColumn("__q_least", F.least(*each))
    best = F.lit(names[0])
    for name, x in reversed(list(zip(names, each, strict=True))):
        best = F.when(x == F.col("__q_least"), name).otherwise(best)
    rest = [c for c in pages.columns if c != "bytes"]
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("encoder"), x.alias("bytes")) for name, x in zip(names, each, strict=True)]))
    out = sizes.select(*rest, "__q_least", best.alias("__q_best"), rows)
    return out.select(*rest, "encoder", "bytes", F.round(F.col("bytes") / F.col("__q_least"), 6).alias("times_least"), (F.col("encoder") == F.col("__q_best")).alias("is_best"))


def best_encoder(results: DataFrame, by: list[str]) -> DataFrame:
    """Per group the encoder of the fewest bytes (ties: name), and each one's size over the least."""
    w = Window.partitionBy(*by)
    return results.withColumns({"least": F.min("bytes").over(w), "best": F.min(F.struct("bytes", "encoder")).over(w)}).withColumns(
        {"times_least": F.round(F.col("bytes") / F.col("least"), 6), "is_best": F.col("encoder") == F.col("best.encoder")}
    ).drop("least", "best")
