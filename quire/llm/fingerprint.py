"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy; the rarer its value is among all windows of the corpus, the higher the window
ranks. In every 64 neighbouring windows the best is chosen, and windows chosen often enough are a text's features.
They go, in the order of the text, into a chain of Bloom filters. Two fingerprints are as like as the bits of their
filters overlap, less what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WINDOW = 64
#: Windows that compete, and how often one must be chosen to be a feature.
NEIGHBOURS, CHOSEN = 64, 16
#: Steps of the entropy scale; windows below LEAST of it say too little to be features.
STEPS, LEAST = 1000, 100
#: Bits of a filter, bits that a feature sets, features of a filter.
BITS, SET, FULL = 2048, 5, 160
#: Of the way from chance to the most that two filters can share, what counts as nothing.
CUT = 0.3
#: Bytes of texts that are looked at together.
TOGETHER = 200_000

_SCALE = 1 << 32
_PART = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], dtype=np.int64)
_MOST = round(WINDOW * np.log2(WINDOW) * _SCALE)


def _powers() -> np.ndarray:
    out, m = [1], 0x9E3779B97F4A7C15 | 1
    for _ in range(WINDOW - 1):
        out.append(out[-1] * m % (1 << 64))
    return np.array(out, dtype=np.uint64)


_POWERS = _powers()


def entropies(b: np.ndarray) -> np.ndarray:
    """Entropy, in 0 to STEPS, of the window at each byte that begins a whole one."""
    n = len(b) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    after, before = np.zeros(len(b), dtype=np.uint8), np.zeros(len(b), dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (b[:-d] == b[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    # the sum of c * log2(c) over the counts c of a window, kept up to date from window to window
    grow = np.diff(_PART)
    total = np.empty(n, dtype=np.int64)
    total[0] = _PART[np.bincount(b[:WINDOW])].sum()
    total[1:] = grow[before[WINDOW:]] - grow[after[: n - 1]]
    np.cumsum(total, out=total)
    return ((_MOST - total) * (STEPS / _MOST)).astype(np.int64)


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features, in the text's order; ranks: by entropy, 0 is best. A text of fewer bytes than a window is its own feature; an empty one has none."""
    out: list[np.ndarray] = []
    for lo, hi in _together(texts):
        b = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        bounds = np.cumsum([0, *map(len, texts[lo:hi])])
        keys = (ranks[entropies(b)] << 32) | np.arange(max(0, len(b) - WINDOW + 1))
        best, s = keys, 1
        while s < NEIGHBOURS:
            best, s = np.minimum(best[:-s], best[s:]), 2 * s
        for t, x, y in zip(texts[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = y - x - WINDOW + 1
            if n <= 0:
                out.append(np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), dtype="<u8") if t else np.zeros(0, dtype=np.uint64))
                continue
            rounds = n - NEIGHBOURS + 1
            places = (best[x : x + rounds] if rounds > 0 else keys[x : x + n].min(keepdims=True)) & 0xFFFFFFFF
            chosen = np.bincount(places - x, minlength=n)
            at = np.flatnonzero(chosen >= min(CHOSEN, max(1, rounds)))
            good = at[ranks[-1] > (keys[x + at] >> 32)]
            at = x + (good if len(good) else at[:1] if len(at) else np.array([int(places[0]) - x]))
            with np.errstate(over="ignore"):
                h = (b[at[:, None] + np.arange(WINDOW)].astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64)
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def _filters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters (rows of BITS booleans) and the features in each."""
    n = -(-len(h) // FULL)
    bits = np.zeros((n, BITS), dtype=bool)
    row = np.arange(len(h)) // FULL
    for k in range(SET):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
    return bits, np.bincount(row, minlength=n)


def encoded(bits: np.ndarray, counts: np.ndarray) -> str:
    """The text of a fingerprint: for each filter its number of features, a byte, and its bits, in base 64."""
    return base64.b64encode(b"".join(bytes([int(c)]) + np.packbits(x).tobytes() for c, x in zip(counts, bits, strict=True))).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 1 + BITS // 8)
    return np.unpackbits(raw[:, 1:], axis=1).astype(bool), raw[:, 0].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the mean, over the filters of the fingerprint that has fewer, of the best normalised overlap with the other's. Two without filters are alike; with one of them, none."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]):
        a, b = b, a
    shared_bits = a[0].astype(np.float32) @ b[0].astype(np.float32).T
    most = np.minimum(a[0].sum(axis=1)[:, None], b[0].sum(axis=1)[None, :])
    q = 1 - 1 / BITS
    x, y = q ** (SET * a[1])[:, None], q ** (SET * b[1])[None, :]
    chance = np.minimum(BITS * (1 - x - y + x * y), most)
    cut = chance + CUT * (most - chance)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(shared_bits >= most, 1.0, np.where(shared_bits <= cut, 0.0, (shared_bits - cut) / (most - cut)))
    return float(np.clip(score.max(axis=1), 0, 1).mean())


def _histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(STEPS + 1, dtype=np.int64)
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["content"]]
        for lo, hi in _together(texts):
            e = entropies(np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8))
            real = np.ones(len(e), dtype=bool)
            for end in np.cumsum(list(map(len, texts[lo:hi])))[:-1].tolist():
                real[max(0, end - WINDOW + 1) : end] = False
            total += np.bincount(e[real], minlength=STEPS + 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"entropy": at, "n": total[at]})


def entropy_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy, by the number of windows of all texts that have it: the rarest is 0; ties: the lower entropy first.

    Entropies below LEAST come last, all with one rank, and give features only to texts that have no others. The result
    has STEPS + 1 numbers, whatever the corpus holds.
    """
    shared.prepare(docs.sparkSession)
    counted = docs.select(shared.text_or_empty(text).alias("content")).mapInPandas(_histogram, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    n = np.zeros(STEPS + 1, dtype=np.int64)
    for r in counted.collect():
        n[r["entropy"]] = r["n"]
    ranks = np.full(STEPS + 2, STEPS + 1, dtype=np.int64)
    order = np.lexsort((np.arange(LEAST, STEPS + 1), n[LEAST:])) + LEAST
    ranks[order] = np.arange(len(order))
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row. Null text counts as empty, whose fingerprint is the empty string; equal texts have equal ones; an empty table gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = features([t.encode("utf-8", "surrogatepass") for t in b["content"]], ranks)
            yield pd.DataFrame({key: b[key], "fingerprint": [encoded(*_filters(h)) for h in found]})

    shared.prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("fingerprint", T.StringType())])
    out = docs.select(shared.key_text(key), shared.text_or_empty(text).alias("content")).mapInPandas(run, schema)
    return out.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def edited(text: str, following: str) -> str:
    """The last third of the characters gives way to the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


COMPARED = (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))


def _compare(ranks: np.ndarray, key: str):
    """Of each pair of neighbours in a partition the first gives a row (end 0); the partition's first and last texts follow (end 1 and 2)."""

    def rows(group: list[tuple]) -> pd.DataFrame:
        return _rows(ranks, key, group, [t for _, t in group[1:]]).assign(part=0, end=0, content=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, first = [], None
        for batch in batches:
            for b in shared.by_bytes(batch, "content", 2_000_000):
                now = kept + list(zip(b["key"], b["content"], strict=True))
                first = first or now[0]
                yield rows(now)
                kept = now[-1:]
        if kept:
            ends = pd.DataFrame({key: [first[0], kept[0][0]], "n_chars": 0, "edited_sha256": None, "fingerprint": None, "edited_fingerprint": None, "near_edited": 0.0, "near_next": 0.0})
            yield ends.assign(part=TaskContext.get().partitionId(), end=[1, 2], content=[first[1], kept[0][1]])

    return run


def _rows(ranks: np.ndarray, key: str, group: list[tuple[str | None, str]], following: list[str]) -> pd.DataFrame:
    """A row for each (key, text) of group that has a following text; more of the group only lend their fingerprints."""
    texts = [t for _, t in group]
    prints = [_filters(h) for h in features([t.encode("utf-8", "surrogatepass") for t in [*texts, *following[len(texts) - 1 :]]], ranks)]
    changed = [edited(t, after).encode("utf-8", "surrogatepass") for t, after in zip(texts, following)]
    changed_prints = [_filters(h) for h in features(changed, ranks)]
    out = [
        (group[i][0], len(texts[i]), hashlib.sha256(c).hexdigest(), encoded(*prints[i]), encoded(*p), likeness(prints[i], p), likeness(prints[i], prints[i + 1]))
        for i, (c, p) in enumerate(zip(changed, changed_prints, strict=True))
    ]
    return pd.DataFrame(out, columns=[key, *(c for c, _ in COMPARED)])


def _close(ranks: np.ndarray, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text, after in zip(batch["key"], batch["content"], batch["following"], strict=True):
                yield _rows(ranks, key, [(k, text)], [after])

    return run


def compare_with_edits(docs: DataFrame, parts: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with its text's fingerprint, that of its edited text, and how like they and the next row's are.

    The next row is the one of the next smaller key, after the last the first; null keys come last, equal keys in the
    order of their texts' digests. Columns: key (a long), n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null text counts as empty. A single row is its own next. An empty table gives none.

    Rows are sorted by ranges of key and digest (parts of them; by default as many as the session's shuffles have), so
    a key that many rows share is dealt to several tasks, which read their rows as streams and move each text once.
    A task also writes its first and last text; from those, two for each task, come the rows that cross from one range
    to the next.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    ranks = entropy_ranks(docs, text)
    rows = docs.select(F.col(key).cast("long").alias("key"), shared.text_or_empty(text).alias("content"))
    order = (F.coalesce("key", F.lit(-(1 << 63))).desc(), F.col("key").desc_nulls_last(), F.md5("content"))
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select(shared.key_text("key"), "content")
    out = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(c, kind) for c, kind in COMPARED)])
    more = [T.StructField("part", T.LongType()), T.StructField("end", T.IntegerType()), T.StructField("content", T.StringType())]
    held = shared.save(dealt.mapInPandas(_compare(ranks, key), T.StructType(out.fields + more)), "neighbours")
    # one row for each task that had rows
    first = held.where("end = 1").select("part", F.col("content").alias("following"))
    parted = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("part").over(parted), F.first("part").over(parted)).alias("next"))
    last = held.where("end = 2").select(F.col(key).alias("key"), "content", "part").join(after, "part")
    crossing = last.join(first.withColumnRenamed("part", "next"), "next").select("key", "content", "following").mapInPandas(_close(ranks, key), out)
    return held.where("end = 0").select(*out.names).union(crossing).withColumn(key, F.col(key).cast("long"))
