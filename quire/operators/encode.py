"""Encodings of pages and the walking of encoded files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.shipping import ship
from quire.operators import kernels

ADLER = 65521


def adler_part(column):
    """What a chunk of bytes gives to a check sum: its length, its sum, and the sum of its running sums."""
    from .text import byte_values

    zero = F.lit(0).cast("long")
    step = lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["w"] + acc["s"] + v).alias("w"))
    both = F.aggregate(F.transform(byte_values(column), lambda v: v.cast("long")), F.struct(zero.alias("s"), zero.alias("w")), step)
    return F.struct(F.octet_length(column).cast("long").alias("n"), (both["s"] % ADLER).alias("s"), (both["w"] % ADLER).alias("w"))


def adler_joined(x, y):
    """The part of two chunks that follow each other; in whichever order three are joined, the result is the same."""
    return F.struct((x["n"] + y["n"]).alias("n"), ((x["s"] + y["s"]) % ADLER).alias("s"), ((x["w"] + x["s"] * (y["n"] % ADLER) + y["w"]) % ADLER).alias("w"))


def adler_sum(part):
    return (part["n"] + part["w"]) % ADLER * 65536 + (1 + part["s"]) % ADLER


def adler32(column, chunk: int = 1 << 20):
    """Adler-32 of binary, by the library, chunk bytes at a time. Null for null."""

    def of(data):
        if data is None:
            return None
        view, value = memoryview(data), 1
        for at in range(0, len(view), chunk):
            value = zlib.adler32(view[at : at + chunk], value)
        return value

    return F.pandas_udf(lambda s: s.__class__([of(b) for b in s], dtype="Int64"), "long")(column)


def signature(data: bytes) -> int:
    """FNV-style 64-bit fold of bytes, wrapping."""
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def signatures(rows: list[bytes]) -> np.ndarray:
    """signature() of many, a byte of all of them at a time."""
    order = np.argsort([-len(b) for b in rows], kind="stable")
    sizes = np.array([len(rows[i]) for i in order], dtype=np.int64)
    h = np.full(len(rows), 0xCBF29CE484222325, dtype=np.uint64)
    whole = np.zeros((len(rows), int(sizes[0]) if len(rows) else 0), dtype=np.uint8)
    for k, i in enumerate(order):
        whole[k, : sizes[k]] = np.frombuffer(rows[i], dtype=np.uint8)
    # the longest first, so those that still have a byte are the first few
    live = np.searchsorted(-sizes, -np.arange(1, whole.shape[1] + 1), side="right")
    with np.errstate(over="ignore"):
        for at, n in enumerate(live.tolist()):
            h[:n] = (h[:n] ^ whole[:n, at]) * np.uint64(0x100000001B3)
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = h.view(np.int64)
    return out


def pixel_signature(column):
    return F.pandas_udf(lambda s: s.__class__(signatures([bytes(b) for b in s])), "long")(column)


def predicted_rows(page: np.ndarray, bytes_per_pixel: int = 1) -> bytes:
    """Rows of filter type and filtered bytes, the filter of each with the least sum of absolute signed bytes, the lowest of equal ones.

    Neighbours to the left are bytes_per_pixel away, as a decoder takes them for that many channels.
    """
    rows = page.reshape(len(page), -1).astype(np.int64)
    up = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    k = bytes_per_pixel
    left, corner = (np.hstack([np.zeros((len(rows), k), np.int64), x[:, :-k]]) for x in (rows, up))
    p = left + up - corner
    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    all_ = np.stack([rows % 256, (rows - left) % 256, (rows - up) % 256, (rows - (left + up) // 2) % 256, (rows - paeth) % 256])
    best = np.where(all_ < 128, all_, 256 - all_).sum(axis=2).argmin(axis=0)
    chosen = all_[best, np.arange(len(rows))].astype(np.uint8)
    return np.hstack([best[:, None].astype(np.uint8), chosen]).tobytes()


def unpredicted(data: bytes, height: int, row_bytes: int, bytes_per_pixel: int = 1) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(height, row_bytes + 1).astype(np.int64)
    out = np.zeros((height, row_bytes), np.int64)
    for y in range(height):
        up = out[y - 1] if y else np.zeros(row_bytes, np.int64)
        for x in range(row_bytes):
            a = out[y, x - bytes_per_pixel] if x >= bytes_per_pixel else 0
            c = up[x - bytes_per_pixel] if x >= bytes_per_pixel else 0
            b = up[x]
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            add = (0, a, b, (a + b) // 2, a if pa <= pb and pa <= pc else b if pb <= pc else c)[int(raw[y, 0])]
            out[y, x] = (raw[y, x + 1] + add) % 256
    return out.astype(np.uint8)


def flate(page: np.ndarray, predictor: bool = True) -> bytes:
    channels = 1 if page.ndim == 2 else page.shape[2]
    return zlib.compress(predicted_rows(page, channels) if predictor else page.tobytes(), 9)


def packed(page: np.ndarray, threshold: int, white_pad: bool = True) -> bytes:
    """A 1-bit plane: 1 is white and so are missing bits, or 1 is ink and they are not."""
    bits = (page > threshold) if white_pad else (page <= threshold)
    pad = -bits.shape[1] % 8
    return np.packbits(np.pad(bits, ((0, 0), (0, pad)), constant_values=white_pad), axis=1).tobytes()


def layers(page: np.ndarray) -> dict | None:
    """A page's ink as a 1-bit mask of one colour over a background of a third of its size; none where the mask is of no use."""
    g = kernels.gray(page)
    threshold, ink = kernels.otsu(g)
    if not 0.001 < ink < 0.45:
        return None
    dark = g <= threshold
    rgb = page if page.ndim == 3 else page[..., None]
    color = [min(0.35, float(rgb[..., min(c, rgb.shape[2] - 1)][dark].mean()) / 255 * 0.85) for c in range(3)]
    paper = rgb[~dark].reshape(-1, rgb.shape[2]).mean(axis=0)
    back = np.where(dark[..., None], np.floor(paper + 0.5).astype(np.uint8), rgb)
    back = kernels.resize(back if page.ndim == 3 else back[..., 0], max(1, page.shape[0] // 3), max(1, page.shape[1] // 3))
    return {"stream": flate(back), "back_width": back.shape[1], "back_height": back.shape[0], "mask": zlib.compress(packed(g, threshold, False), 9), "ink": color}


def encoded(page: np.ndarray, compress: dict) -> dict:
    """A page as its document holds it: mode, the image's stream and what a reader must know of it, and a note where another encoder than the one asked for was used.

    Of the encoders only Flate is here, so it stands in for all others. A layered page is written where that is allowed
    and smaller by more than 4096 bytes.
    """
    mode = kernels.page_mode(page, compress)
    asked = compress.get("mono_encoder" if mode == "mono" else "encoder", "ccitt" if mode == "mono" else "jpeg")
    note = None if asked in ("zip", "flate") else f"{asked} is not available: written as {'flate' if mode == 'mono' else 'zip'}"
    h, w = page.shape[:2]
    out = {"width": w, "height": h, "mode": mode, "colors": 1, "bits": 8, "predictor": True, "mask": None, "ink": None, "back_width": w, "back_height": h, "note": note}
    if mode == "mono":
        g = kernels.gray(page)
        return out | {"bits": 1, "predictor": False, "stream": zlib.compress(packed(g, kernels.otsu(g)[0]), 9)}
    page = kernels.gray(page) if mode == "gray" else page
    out |= {"colors": 1 if page.ndim == 2 else 3, "stream": flate(page)}
    lossless = compress.get("encoder", "jpeg") in ("zip", "jp2lossless")
    if compress.get("adaptive", True) and not lossless:
        split = layers(page)
        if split and len(split["stream"]) + len(split["mask"]) + 4096 < len(out["stream"]):
            out |= split
    return out


LINES = "array<struct<text:string,x:double,y:double,w:double,h:double>>"
ENCODED = f"doc string, page_no int, width int, height int, mode string, colors int, bits int, predictor boolean, stream binary, back_width int, back_height int, mask binary, ink array<double>, note string, lines {LINES}"


def encode_pages(pages: DataFrame, compress: dict | None = None, kernel=None) -> DataFrame:
    """Pages as their documents hold them, after a kernel if there is one, encoded where they are read; lines pass."""
    import pandas as pd

    names = [c.split()[0] for c in ENCODED.split(", ")[:15]]
    settings = compress or {}

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                page = kernels.unpack(r)
                got = encoded(kernel(page) if kernel else page, settings)
                yield pd.DataFrame([got | {"doc": r.doc, "page_no": r.page_no, "lines": r.lines}], columns=names)

    ship(pages.sparkSession)
    lines = F.col("lines") if "lines" in pages.columns else F.lit(None).cast(LINES).alias("lines")
    return pages.select("doc", "page_no", "width", "height", "channels", "data", lines).mapInPandas(run, ENCODED)


def bench(pages: DataFrame) -> DataFrame:
    """(doc, page_no, encoding, bytes): each page's size by every encoding that is here; layered where there is a usable mask."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                page = kernels.unpack(r)
                g, split = kernels.gray(page), layers(page)
                sizes = {"flate": len(flate(page, False)), "flate with predictor": len(flate(page)), "gray": len(flate(g)), "mono": len(zlib.compress(packed(g, kernels.otsu(g)[0]), 9))}
                if split:
                    sizes["layered"] = len(split["stream"]) + len(split["mask"])
                out += [(r.doc, r.page_no, k, n) for k, n in sizes.items()]
            yield pd.DataFrame(out, columns=["doc", "page_no", "encoding", "bytes"])

    ship(pages.sparkSession)
    return pages.select("doc", "page_no", "width", "height", "channels", "data").mapInPandas(run, "doc string, page_no int, encoding string, bytes long")


def framed(data: bytes, raw: bytes) -> bytes:
    """A zlib stream: data if it is one, else its raw deflate in a frame with the check sum of the bytes it holds."""
    if len(data) >= 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0:
        return data
    return b"\x78\x9c" + data + struct.pack(">I", zlib.adler32(raw))


def inflated(data: bytes) -> bytes:
    """A stream's content: inflated with or without a frame, or as it is."""
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            pass
    return data


def streams(data: bytes, most: int = 400) -> list[bytes]:
    """What stands between stream and endstream, without one CR and one LF at the start; empty ones are left out, and all after one that does not end."""
    out, at = [], 0
    while len(out) < most:
        a = data.find(b"stream", at)
        if a < 0:
            break
        a += 6
        a += data[a : a + 1] == b"\r"
        a += data[a : a + 1] == b"\n"
        b = data.find(b"endstream", a)
        if b < 0:
            break
        if b > a:
            out.append(data[a:b])
        at = b + 9
    return out


def text_chars(body: str) -> int:
    """Characters that a content stream shows: of literals, and of hex strings before Tj or TJ half their digits."""
    count, i, n = 0, 0, len(body)
    while i < n:
        if body[i] == "(":
            depth, i = 1, i + 1
            while i < n and depth:
                c = body[i]
                if c == "\\":
                    count, i = count + 1, i + 2
                    continue
                depth += (c == "(") - (c == ")")
                count += c not in "()"
                i += 1
            continue
        if body[i] == "<":
            j = i + 1
            while j < n and body[j] in "0123456789abcdefABCDEF":
                j += 1
            digits = j - i - 1
            if digits > 1 and body[j : j + 1] == ">":
                k = j + 1
                while k < n and body[k] in " \n\r\t":
                    k += 1
                count += digits // 2 if body[k : k + 2] in ("Tj", "TJ") else 0
                i = j + 1
                continue
        i += 1
    return count


def jpeg_components(data: bytes) -> int | None:
    """Components that a JPEG's frame header names, or none."""
    if data[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 9 < len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        m = data[i + 1]
        if m == 0xFF or m == 0x01 or 0xD0 <= m <= 0xD9:
            i += 1 if m == 0xFF else 2
            continue
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            return data[i + 9]
        i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    return None


def tiff_strips(data: bytes, most: int = 200) -> bytes | None:
    """The strips of a TIFF's first image, one after the other; none if it is none, or if offsets and counts do not match."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        return None
    found: dict[int, list[int]] = {}
    for k in range(min(most, struct.unpack(order + "H", data[at : at + 2])[0])):
        e = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) < 12:
            return None
        tag, kind, count = struct.unpack(order + "HHI", e[:8])
        if tag in (273, 279) and kind in (3, 4):
            size, code = (2, "H") if kind == 3 else (4, "I")
            raw = e[8:12] if count * size <= 4 else data[(p := struct.unpack(order + "I", e[8:12])[0]) : p + count * size]
            if len(raw) < count * size:
                return None
            found[tag] = list(struct.unpack(order + code * count, raw[: count * size]))
    offsets, counts = found.get(273), found.get(279)
    if not offsets or not counts or len(offsets) != len(counts) or any(o + c > len(data) for o, c in zip(offsets, counts)):
        return None
    return b"".join(data[o : o + c] for o, c in zip(offsets, counts))


def walked(rows: DataFrame, walk, result: str, content: str = "content") -> DataFrame:
    """rows with what a walk finds in their content, in its place. result: the name and type of that."""
    name, kind = result.split()
    found = F.pandas_udf(lambda s: s.__class__([walk(bytes(b)) for b in s], dtype=object), kind)
    ship(rows.sparkSession)
    return rows.withColumn(name, found(F.col(content))).drop(content)


def png(page: np.ndarray) -> bytes:
    """A PNG of a gray or RGB page."""
    channels = 1 if page.ndim == 2 else 3
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", page.shape[1], page.shape[0], 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", flate(page)) + chunk(b"IEND", b"")


def visible_text(html: str) -> str:
    """What a page shows: its data outside of style, script, head and title."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        hidden = frozenset(("style", "script", "head", "title"))

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag in self.hidden

        def handle_endtag(self, tag):
            self.depth -= tag in self.hidden and self.depth > 0

        def handle_data(self, data):
            if not self.depth:
                self.parts.append(data)

    r = Reader()
    r.feed(html or "")
    return "".join(r.parts)


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    ship(pages.sparkSession)
    udf = F.pandas_udf(lambda s: s.map(visible_text), "string")
    return pages.select(key, udf(F.coalesce(F.col(html), F.lit(""))).alias("visible"))
