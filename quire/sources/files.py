"""Documents and images as files, and synthetic pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.shipping import ship
from quire.operators import encode, text


#: Bytes of streams that stream_rows gives back at a time.
HELD = 8_000_000


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc, content, file_size) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content", F.col("length").alias("file_size"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page_no, width, height, channels, data) of image files; colours come as RGB."""
    got = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def flip(batches):
        for b in batches:
            turned = [np.frombuffer(d, np.uint8).reshape(-1, n)[:, 2::-1].tobytes() if n >= 3 else d for d, n in zip(b["data"], b["nChannels"], strict=True)]
            yield b.assign(data=turned, nChannels=b["nChannels"].clip(upper=3))

    out = got.select("origin", "width", "height", "nChannels", "data").mapInPandas(flip, "origin string, width int, height int, nChannels int, data binary")
    return out.select(F.element_at(F.split("origin", "/"), -1).alias("doc"), F.lit(0).alias("page_no"), "width", "height", F.col("nChannels").alias("channels"), "data")


def stream_rows(docs: DataFrame, most: int = 400) -> DataFrame:
    """(doc, stream_no, body): each document's streams, inflated where they can be."""

    def run(batches):
        import pandas as pd

        frame = lambda: pd.DataFrame({"doc": docs_, "stream_no": numbers, "body": bodies})
        for b in batches:
            docs_, numbers, bodies, held = [], [], [], 0
            for doc, content in zip(b["doc"], b["content"], strict=True):
                for n, body in enumerate(map(encode.inflated, encode.streams(bytes(content), most))):
                    docs_.append(doc)
                    numbers.append(n)
                    bodies.append(body)
                    held += len(body)
                    # many small documents make one frame, large ones several
                    if held > HELD:
                        yield frame()
                        docs_, numbers, bodies, held = [], [], [], 0
            if docs_:
                yield frame()

    ship(docs.sparkSession)
    return docs.select("doc", "content").mapInPandas(run, T.StructType([docs.schema["doc"], T.StructField("stream_no", T.IntegerType()), T.StructField("body", T.BinaryType())]))


def text_layers(docs: DataFrame) -> DataFrame:
    """(doc, chars): characters shown by the streams that look like page content."""
    body = F.decode("body", "ISO-8859-1")
    chars = F.pandas_udf(lambda s: s.map(encode.text_chars), "long")
    rows = stream_rows(docs).select("doc", body.alias("body"))
    counted = rows.where(text.content_stream(F.col("body"))).select("doc", chars("body").alias("n")).groupBy("doc").agg(F.sum("n").alias("chars"))
    return docs.select("doc").join(counted, "doc", "left").select("doc", F.coalesce("chars", F.lit(0)).alias("chars"))


def info_title(content: Column) -> Column:
    """The literal title of the information dictionary, its escapes undone; null without one."""

    def undo(raw: str | None) -> str | None:
        if raw is None:
            return None
        out, i = bytearray(), 0
        while i < len(raw):
            if raw[i] == "\\" and raw[i + 1 : i + 4].isdigit():
                out.append(int(raw[i + 1 : i + 4], 8) & 255)
                i += 4
            else:
                i += raw[i] == "\\"
                out.append(ord(raw[i]))
                i += 1
        return out.decode("utf-8", "replace")

    found = F.regexp_extract(F.decode(content, "ISO-8859-1"), r"(?s)/Title \(((?:[^()\\]|\\.)*)\)", 1)
    return F.pandas_udf(lambda s: s.map(undo), "string")(F.nullif(found, F.lit("")))


def noise(seed: int, n: int) -> np.ndarray:
    """n numbers from -12 to 12 of a linear congruential sequence, each from its own power of the multiplier."""
    with np.errstate(over="ignore"):
        a = np.cumprod(np.full(n, 2862933555777941757, dtype=np.uint64))
        steps = np.cumsum(np.concatenate([np.ones(1, dtype=np.uint64), a[:-1]])) if n else a
        state = a * np.uint64(seed) + np.uint64(3037000493) * steps
    return (state >> np.uint64(58)).astype(np.int64) % 25 - 12


def _scan(h: int, w: int, seed: int) -> np.ndarray:
    page = 250.0 - 40.0 * np.linspace(0, 1, w)[None, :] * np.ones((h, 1))
    page[20 : h - 20 : 12, 15 : w - 15] = 30
    return page + noise(seed, h * w).reshape(h, w)


def _photo(h: int, w: int, seed: int) -> np.ndarray:
    fy, fx = np.mgrid[0:h, 0:w] / np.array([h, w]).reshape(2, 1, 1)
    page = 255.0 * (1 - 0.20 * fx - 0.14 * fy - 0.08 * fx * fy)
    page[h // 8 : h - h // 8 : 12, w // 10 : w - w // 10] *= 0.2
    return page + noise(seed, h * w).reshape(h, w)


def _desk(h: int, w: int, seed: int) -> np.ndarray:
    """A bright page with a dark mark near its upper left corner, on a dark desk."""
    page = 255.0 * np.linspace(0.34, 0.22, h)[:, None] * np.ones((1, w))
    y, x = int(0.16 * h), int(0.16 * w)
    page[y : h - y, x : w - x] = 250
    top, left = y + int(0.14 * (h - 2 * y)), x + int(0.12 * (w - 2 * x))
    page[top : top + max(1, h // 40), left : left + max(1, w // 20)] = 20
    return page


def _quadrant(h: int, w: int, seed: int) -> np.ndarray:
    page = np.full((h, w), 255.0)
    page[: h // 4, : w // 4] = 0
    return page


def _gradient(h: int, w: int, seed: int) -> np.ndarray:
    page = np.linspace(250, 150, w)[None, :] * np.ones((h, 1))
    page[h // 8 : h - h // 8 : 12, w // 10 : w - w // 10] *= 0.55
    return page


def _specks(h: int, w: int, seed: int) -> np.ndarray:
    page = np.full(h * w, 250.0)
    with np.errstate(over="ignore"):
        page[np.cumsum(np.abs(noise(seed, max(1, h * w // 625))) * 97 + 1) % (h * w)] = 230
    return page.reshape(h, w)


#: Kinds of synthetic pages.
KINDS = {"scan": _scan, "photo": _photo, "desk": _desk, "quadrant": _quadrant, "gradient": _gradient, "specks": _specks}


def synthetic_pages(spark: SparkSession, documents_: int, pages: int, height: int = 160, width: int = 120, seed: int = 11, kind: str = "scan") -> DataFrame:
    """Pages of a kind: dark lines on paper with shade and noise, a photo's fall of light, a page on a desk, a dark corner, a gradient, specks."""
    draw = KINDS[kind]

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                page = np.clip(draw(height, width, seed + r.doc_no * 1009 + r.page_no), 0, 255).astype(np.uint8)
                yield pd.DataFrame({"doc": [f"d{r.doc_no}"], "page_no": [r.page_no], "width": [width], "height": [height], "channels": [1], "data": [page.tobytes()]})

    ship(spark)
    grid = spark.range(documents_ * pages).select((F.col("id") / pages).cast("int").alias("doc_no"), (F.col("id") % pages).cast("int").alias("page_no"))
    return grid.mapInPandas(run, "doc string, page_no int, width int, height int, channels int, data binary")
