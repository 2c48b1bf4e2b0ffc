"""Page kernels on numpy arrays, for pages too large to be rows of pixels.

A page is a row of width, height, channels and data (bytes, row by row from the top). The kernels that SQL can express
have twins in pixels.py; rotation, smoothing and the like follow no outside renderer bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.shipping import ship

WHITE = 255.0


def gray(page: np.ndarray) -> np.ndarray:
    """Integer luma of an RGB page; a gray one as it is."""
    if page.ndim == 2:
        return page
    p = page.astype(np.int64)
    return ((p[..., 0] * 299 + p[..., 1] * 587 + p[..., 2] * 114) // 1000).astype(np.uint8)


def shrink(page: np.ndarray, longest: int) -> np.ndarray:
    """Mean of areas, so that the long side is at most longest."""
    h, w = page.shape[:2]
    k = longest / max(h, w)
    return page if k >= 1 else resize(page, max(1, round(h * k)), max(1, round(w * k)))


def resize(page: np.ndarray, h: int, w: int) -> np.ndarray:
    out = page.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        size = out.shape[axis]
        edges = np.linspace(0, size, n + 1)
        total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        whole = np.minimum(edges.astype(int), size - 1)
        shape = [1] * out.ndim
        shape[axis] = n + 1
        at = np.take(total, whole, axis) + np.take(out, whole, axis) * (edges - whole).reshape(shape)
        out = np.diff(at, axis=axis) / (size / n)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def percentile(values: np.ndarray, p: float) -> int:
    hist = np.bincount(values.reshape(-1), minlength=256)
    target = int(values.size * p)
    return int(np.searchsorted(np.cumsum(hist), target)) if target else 0


def contrast(g: np.ndarray) -> int:
    return percentile(g, 0.9) - percentile(g, 0.1)


def paper_level(g: np.ndarray) -> int:
    down = np.cumsum(np.bincount(g.reshape(-1), minlength=256)[::-1])
    return int(255 - np.searchsorted(down, g.size - int(g.size * 0.8)))


def otsu(g: np.ndarray) -> tuple[int, float]:
    n = np.bincount(g.reshape(-1), minlength=256).astype(np.float64)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    between = np.zeros(256)
    between[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]) ** 2
    t = int(np.argmax(between)) if between.max() > 0 else 128
    return t, float((g <= t).mean()) if g.size else 0.0


def laplacian(g: np.ndarray) -> np.ndarray:
    p = g.astype(np.int64)
    return p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] - 4 * p[1:-1, 1:-1]


def noise(g: np.ndarray) -> float:
    if min(g.shape) <= 3:
        return 0.0
    bins, inside = np.zeros(256, dtype=np.int64), g.shape[0] - 1
    # by bands of rows, as these numbers take eight bytes a pixel and more
    for y in range(1, inside, 1024):
        lap = np.minimum(255, np.abs(laplacian(g[y - 1 : min(y + 1024, inside) + 1])) // 4)
        bins += np.bincount(lap.reshape(-1), minlength=256)
    return min(1.0, int(np.searchsorted(np.cumsum(bins), bins.sum() // 2)) / 12)


def unevenness(g: np.ndarray, grid: int = 12) -> float:
    h, w = g.shape
    levels = []
    for gy in range(grid):
        for gx in range(grid):
            y0, x0 = gy * h // grid, gx * w // grid
            tile = g[y0 : max(y0 + 1, (gy + 1) * h // grid), x0 : max(x0 + 1, (gx + 1) * w // grid)]
            if tile.size:
                levels.append(float(tile[tile >= percentile(tile, 0.8)].mean()))
    levels.sort()
    if len(levels) < 4:
        return 0.0
    lo, hi = levels[int(len(levels) * 0.1)], levels[min(len(levels) - 1, int(len(levels) * 0.9))]
    return 0.0 if hi <= 1 else min(1.0, max(0.0, (hi - lo) / hi))


def row_score(g: np.ndarray) -> float:
    return 0.0 if len(g) <= 2 else float((np.diff(g.mean(axis=1)) ** 2).sum() / len(g))


def rotate(page: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, bilinear, white outside, same size."""
    h, w = page.shape[:2]
    t = math.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    sx = math.cos(t) * (x - cx) + math.sin(t) * (y - cy) + cx
    sy = -math.sin(t) * (x - cx) + math.cos(t) * (y - cy) + cy
    return sample(page, sx, sy)


def sample(page: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    pad = ((1, 1), (1, 1)) + ((0, 0),) * (page.ndim - 2)
    p = np.pad(page.astype(np.float64), pad, constant_values=WHITE)
    sx, sy = np.clip(sx + 1, 0, p.shape[1] - 1.001), np.clip(sy + 1, 0, p.shape[0] - 1.001)
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    if page.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = p[y0, x0] * (1 - fx) * (1 - fy) + p[y0, x0 + 1] * fx * (1 - fy) + p[y0 + 1, x0] * (1 - fx) * fy + p[y0 + 1, x0 + 1] * fx * fy
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def detect_skew(page: np.ndarray) -> float:
    """The turn that makes rows most uneven: whole degrees up to 10 either way, then tenths around the best; under 0.15 it is 0."""
    g = shrink(gray(page), 640)

    def best(angles: list[float]) -> float:
        scores = [row_score(rotate(g, a)) for a in angles]
        return angles[int(np.argmax(scores))]

    coarse = best([float(a) for a in range(-10, 11)])
    fine = best([round(coarse + k / 10, 1) for k in range(-10, 11)])
    return 0.0 if abs(fine) < 0.15 else max(-10.0, min(10.0, fine))


def deskew(page: np.ndarray, angle: float) -> np.ndarray:
    """Turned by the angle, one way or the other, whichever leaves the rows more uneven."""
    if abs(angle) < 0.15:
        return page
    a, b = rotate(page, angle), rotate(page, -angle)
    return a if row_score(gray(a)) >= row_score(gray(b)) else b


def box_mean(g: np.ndarray, window: int) -> np.ndarray:
    r = max(1, window // 2)
    out, count = g.astype(np.float64), np.ones(g.shape)
    for axis in (0, 1):
        n = g.shape[axis]
        lo, hi = np.maximum(0, np.arange(n) - r), np.minimum(n, np.arange(n) + r + 1)
        for name in (0, 1):
            a = (out, count)[name]
            total = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
            a = np.take(total, hi, axis) - np.take(total, lo, axis)
            out, count = (a, count) if name == 0 else (out, a)
    return out / count


def binarize(g: np.ndarray, beta: float = 0.90) -> np.ndarray | None:
    """Against the local mean, else Otsu's threshold, whichever first has an acceptable share of ink; else none."""
    window = max(9, (g.shape[1] // 110) | 1)
    for out in (np.where(g < box_mean(g, window) * beta, 0, 255), np.where(g <= otsu(g)[0], 0, 255)):
        if 0.0004 < (out < 128).mean() < 0.45:
            return out.astype(np.uint8)
    return None


def median3(page: np.ndarray) -> np.ndarray:
    pad = ((1, 1), (1, 1)) + ((0, 0),) * (page.ndim - 2)
    p = np.pad(page, pad, mode="edge")
    h, w = page.shape[:2]
    return np.median(np.stack([p[y : y + h, x : x + w] for y in range(3) for x in range(3)]), axis=0).astype(np.uint8)


def weights(radius: float) -> np.ndarray:
    """Of the seven pixels around one, by their distance."""
    k = np.exp(-(np.arange(-3, 4) ** 2) / (2 * radius**2))
    return k / k.sum()


def unsharp(page: np.ndarray, radius: float, amount: float) -> np.ndarray:
    k = weights(radius)
    blur = page.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * page.ndim
        pad[axis] = (3, 3)
        p = np.pad(blur, pad, mode="edge")
        blur = sum(k[i] * np.take(p, range(i, i + page.shape[axis]), axis) for i in range(7))
    return np.clip(np.floor(page + amount * (page - blur) + 0.5), 0, 255).astype(np.uint8)


def sharpen(page: np.ndarray, amount: float = 1.0) -> np.ndarray:
    return page if amount <= 0 else unsharp(page, 1.4, min(1.5, max(0.1, 0.6 * amount)))


def descreen(page: np.ndarray) -> np.ndarray:
    return unsharp(median3(page), 1.2, 0.7)


def remove_background(page: np.ndarray, strength: float, grid: int = 24) -> np.ndarray:
    if strength <= 0.001:
        return page
    rgb = page if page.ndim == 3 else np.repeat(page[..., None], 3, axis=2)
    g, (h, w) = gray(page), page.shape[:2]
    levels = np.full((grid, grid, 3), WHITE)
    for gy in range(grid):
        for gx in range(grid):
            y0, x0 = gy * h // grid, gx * w // grid
            part = np.s_[y0 : max(y0 + 1, (gy + 1) * h // grid), x0 : max(x0 + 1, (gx + 1) * w // grid)]
            if g[part].size:
                levels[gy, gx] = rgb[part][g[part] >= percentile(g[part], 0.85)].mean(axis=0)
    ay = np.clip((np.arange(h) + 0.5) * grid / h - 0.5, 0, grid - 1)
    ax = np.clip((np.arange(w) + 0.5) * grid / w - 0.5, 0, grid - 1)
    y0, x0 = ay.astype(int), ax.astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (ay - y0)[:, None, None], (ax - x0)[None, :, None]
    level = (levels[y0][:, x0] * (1 - fx) + levels[y0][:, x1] * fx) * (1 - fy) + (levels[y1][:, x0] * (1 - fx) + levels[y1][:, x1] * fx) * fy
    factor = np.clip((245 + 10 * strength) / np.maximum(1, level), 1 - 0.18 * strength, 3.0)
    out = np.minimum(255, np.floor(rgb * factor + 0.5)).astype(np.uint8)
    return out if page.ndim == 3 else out[..., 0]


def stretch(page: np.ndarray) -> np.ndarray | None:
    g = shrink(gray(page), 800)
    lo, hi = percentile(g, 0.02), percentile(g, 0.98)
    if hi - lo < 18:
        return None
    table = np.clip(np.floor((np.arange(256) - lo) * 255.0 / (hi - lo) + 0.5), 0, 255).astype(np.uint8)
    return table[page]


def guarded(before: np.ndarray, after: np.ndarray | None) -> np.ndarray:
    """after, unless it lost most of the contrast."""
    if after is None:
        return before
    old, new = contrast(gray(before)), contrast(gray(after))
    return after if old <= 20 or new >= 0.6 * old else before


def boost_color(page: np.ndarray, strength: float) -> np.ndarray:
    page = guarded(page, remove_background(page, strength))
    if page.ndim == 3:
        g = gray(page)[..., None].astype(np.float64)
        x = g + (page - g) * (1.06 + 0.14 * strength)
        x = (x - 127.5) * (1.04 + 0.10 * strength) + 127.5
        page = guarded(page, np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8))
    return guarded(page, sharpen(page, 0.6))


def clean_then_contrast(page: np.ndarray, strength: float) -> np.ndarray:
    page = guarded(page, remove_background(page, strength))
    return guarded(page, stretch(page))


def page_class(page: np.ndarray) -> str:
    if page.ndim == 3:
        hi, lo = page.max(axis=2).astype(int), page.min(axis=2).astype(int)
        lit = hi > 60
        if lit.any() and ((hi - lo)[lit] / hi[lit] > 0.22).mean() > 0.006:
            return "color"
    g = gray(page)
    return "mono" if 0.002 < otsu(g)[1] < 0.6 and ((g > 60) & (g < 195)).mean() < 0.12 else "gray"


def apply_preset(page: np.ndarray, preset: str, strength: float) -> np.ndarray:
    if preset == "original":
        return page
    if preset == "bw":
        g = gray(page)
        out = binarize(median3(g) if noise(g) > 0.06 else g)
        return page if out is None else out
    if preset == "contrast":
        return clean_then_contrast(page, strength)
    if preset == "color":
        return boost_color(page, strength)
    kind = page_class(page)
    if kind == "color":
        return boost_color(page, strength)
    return guarded(page, binarize(gray(page))) if kind == "mono" else clean_then_contrast(page, strength)


def warp(page: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The quad (corners clockwise from the upper left, in pixels from the upper left) made upright."""
    dist = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    w = max(1, round((dist(quad[0], quad[1]) + dist(quad[3], quad[2])) / 2))
    h = max(1, round((dist(quad[0], quad[3]) + dist(quad[1], quad[2])) / 2))
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    y, x = np.mgrid[0:h, 0:w]
    d = m[2, 0] * x + m[2, 1] * y + 1
    return sample(page, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d)


def page_mode(page: np.ndarray, compress: dict) -> str:
    """The mode in which a page is written: as rules.effective_mode, from the page's class."""
    mode, lossless = compress.get("mode", "auto"), compress.get("encoder", "jpeg") in ("zip", "jp2lossless")
    if compress.get("adaptive", True) or mode == "auto":
        kind = page_class(shrink(page, 1200))
        return "gray" if kind == "mono" and lossless else kind
    return mode if mode in ("color", "gray", "mono") else "color"


def boundary(g: np.ndarray, quad: list[tuple[float, float]]) -> tuple[float, float] | None:
    """Mean inside a quad's box (its middle three fifths) and the brightest of the strips around it; none with fewer than two strips."""
    h, w = g.shape
    xs, ys = [min(1.0, max(0.0, x)) for x, _ in quad], [min(1.0, max(0.0, y)) for _, y in quad]
    x0, x1 = max(0, int(min(xs) * w)), min(w - 1, int(max(xs) * w))
    y0, y1 = max(0, int(min(ys) * h)), min(h - 1, int(max(ys) * h))
    if not (x1 > x0 + 2 and y1 > y0 + 2):
        return None
    band, fx, fy = max(2, int(min(w, h) * 0.02)), (x1 - x0) // 5, (y1 - y0) // 5

    def mean(a: int, b: int, c: int, d: int) -> float | None:
        a, b, c, d = max(0, a), min(w - 1, b), max(0, c), min(h - 1, d)
        return float(g[c : d + 1, a : b + 1].mean()) if b > a and d > c else None

    strips = [mean(x0, x1, y0 - band, y0 - 1), mean(x0, x1, y1 + 1, y1 + band), mean(x0 - band, x0 - 1, y0, y1), mean(x1 + 1, x1 + band, y0, y1)]
    inside = mean(x0 + fx, x1 - fx, y0 + fy, y1 - fy)
    found = [s for s in strips if s is not None]
    return (inside, max(found)) if len(found) >= 2 and inside is not None else None


def crop_gate(g: np.ndarray, quad: list[tuple[float, float]]) -> str:
    """The first gate that a quad on a gray page fails, or applied: as rules.crop_gate."""
    x, y = [min(1.0, max(0.0, a)) for a, _ in quad], [min(1.0, max(0.0, b)) for _, b in quad]
    turns = [(x[j] - x[i]) * (y[k] - y[j]) - (y[j] - y[i]) * (x[k] - x[j]) for i, j, k in ((i, (i + 1) % 4, (i + 2) % 4) for i in range(4))]
    if any(t >= 1e-6 for t in turns) == any(t <= -1e-6 for t in turns):
        return "distorted"
    area = min(1.2, abs(sum(quad[i][0] * quad[(i + 1) % 4][1] - quad[(i + 1) % 4][0] * quad[i][1] for i in range(4))) / 2)
    if area >= 0.96 or area < 0.10:
        return "full page" if area >= 0.96 else "too small"
    if max(x) - min(x) < 0.25 or max(y) - min(y) < 0.25:
        return "too narrow"
    sides = boundary(g, quad)
    if sides is None:
        return "unmeasurable"
    return "applied" if sides[0] - sides[1] > 30 else "paper outside"


def border(g: np.ndarray, paperish: float = 240.0, most: float = 0.02) -> tuple[int, int, int, int]:
    """Lines to trim at the top, bottom, left and right: as pixels.border_trim."""
    out = []
    for axis in (0, 1):
        dirty = g.mean(axis=1 - axis) < paperish
        cap = max(1, int(len(dirty) * most))
        for lines in (dirty, dirty[::-1]):
            out.append(min(cap, len(lines) if lines.all() else int(np.argmin(lines))))
    return tuple(out)


def crop(page: np.ndarray, quad: list[tuple[float, float]]) -> tuple[np.ndarray, str]:
    """The quad made upright and what is left of its surroundings trimmed, if it passes the gates; the page as it is and the gate if not."""
    h, w = page.shape[:2]
    gate = crop_gate(gray(page), quad)
    if gate != "applied":
        return page, gate
    page = warp(page, [(min(1, max(0, x)) * w, min(1, max(0, y)) * h) for x, y in quad])
    top, bottom, left, right = border(gray(page))
    return page[top : page.shape[0] - bottom or None, left : page.shape[1] - right or None], "cropped"


def enhance(page: np.ndarray, spec: dict) -> tuple[np.ndarray, list[str]]:
    """The steps in their order: crop, deskew, descreen, clean, preset, sharpen; and notes. Whether a page is clean is judged before cleaning."""
    notes = []
    if spec.get("quad") is not None:
        page, note = crop(page, spec["quad"])
        notes.append(note)
    if spec.get("deskew"):
        page = deskew(page, detect_skew(page))
    if spec.get("descreen"):
        page = guarded(page, descreen(page))
    g = gray(page)
    clean = paper_level(g) >= 249 and g.mean() >= 250 and unevenness(g) <= 0.05
    preset, strength = spec.get("preset"), spec.get("strength", 0.5)
    if clean:
        notes.append("clean")
        strength = 0.0
    if preset is None and spec.get("bg_remove"):
        page = guarded(page, remove_background(page, strength))
    if preset is not None:
        page = apply_preset(page, preset, strength)
    if spec.get("sharpen", 0) > 0:
        page = guarded(page, sharpen(page, spec["sharpen"]))
    return page, notes


def unpack(row) -> np.ndarray:
    shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
    return np.frombuffer(bytes(row.data), dtype=np.uint8).reshape(shape)


PAGE = "doc string, page_no int, width int, height int, channels int, data binary"


def map_pages(pages: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pages after a kernel. A batch holds a page or few: see spark.sql.execution.arrow.maxBytesPerBatch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                out = kernel(unpack(r))
                yield pd.DataFrame({"doc": [r.doc], "page_no": [r.page_no], "width": [out.shape[1]], "height": [out.shape[0]], "channels": [1 if out.ndim == 2 else out.shape[2]], "data": [out.tobytes()]})

    ship(pages.sparkSession)
    return pages.select("doc", "page_no", "width", "height", "channels", "data").mapInPandas(run, PAGE)


METRICS = "doc string, page_no int, mode string, skew double, noise double, unevenness double, paper double, paper_mean double, ink double"


def measure_pages(pages: DataFrame) -> DataFrame:
    """Metrics of each page; the pixels stay in their task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                page = unpack(r)
                g = gray(page)
                out.append((r.doc, r.page_no, page_class(shrink(page, 1200)), detect_skew(page), noise(shrink(g, 900)), unevenness(shrink(g, 480)), float(paper_level(g)), float(g.mean()), otsu(g)[1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in METRICS.split(", ")])

    ship(pages.sparkSession)
    return pages.select("doc", "page_no", "width", "height", "channels", "data").mapInPandas(run, METRICS)


WHOLE = "doc string, page_no int, paper double, paper_mean double, ink double, noise double, unevenness double"


def measure_whole(pages: DataFrame) -> DataFrame:
    """Metrics of all pixels of each page, where measure_pages takes noise and unevenness from shrunk ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                g = gray(unpack(r))
                out.append((r.doc, r.page_no, float(paper_level(g)), float(g.mean()), otsu(g)[1], noise(g), unevenness(g)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WHOLE.split(", ")])

    ship(pages.sparkSession)
    return pages.select("doc", "page_no", "width", "height", "channels", "data").mapInPandas(run, WHOLE)


def pack_raster(rows: DataFrame) -> DataFrame:
    """Pages from rows of pixels: page, y, row (an array). A page is as many bytes as it has pixels, in one row of the result."""
    from pyspark.sql import functions as F

    line = F.array_join(F.transform("row", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    lines = F.array_sort(F.collect_list(F.struct("y", line.alias("data"))))
    g = rows.groupBy("page").agg(F.max(F.size("row")).alias("width"), (F.max("y") + 1).cast("int").alias("height"), lines.alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda p: p["data"]), ""))
    return g.select(F.col("page").cast("string").alias("doc"), F.lit(0).alias("page_no"), "width", "height", F.lit(1).alias("channels"), data.alias("data"))
