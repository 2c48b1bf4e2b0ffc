"""Removal of repeated strings, found in merged Burrows-Wheeler transforms.

A byte goes if a string of length bytes that covers it also starts elsewhere. Sorting the suffixes of all texts in
one place does not scale, so the texts are cut where it loses nothing. Of the grams in a window of length bytes the
first with the least hash is the window's anchor; equal windows have equal anchors at equal places. The windows of a
text with the same anchor are a segment, and equal windows stand only in segments whose anchors have equal hashes.
So segments are grouped by that hash: equal ones are one with a count; of different ones each is cut to what it
shares with another around the anchor. What is left goes, in shards, into Burrows-Wheeler transforms over blocks of
bytes, and the merged transforms' common prefixes of length bytes or more are the repeated strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bwt import Shard, merge

GRAM = 32
#: Bits of an anchor's place; the other bits of the key are its hash.
PLACE = 24
#: Bytes of segments that are merged at a time, and of a shard of them, as long as no group is larger; bytes of a group at most.
BATCH_BYTES, SHARD_BYTES, GROUP_BYTES = 1_000_000, 300_000, 2_000_000


def _hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram (a power of two) of bytes."""
    h, m, s = b.astype(np.uint64) + np.uint64(1), np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while s < gram:
            h, m, s = h[:-s] * m + h[s:], m * m, 2 * s
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def anchors(b: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of bytes, and the first and last start of the windows that it is the anchor of."""
    found, step = [], 1 << 22
    width = length - gram + 1
    n = len(b) - length + 1
    for at in range(0, max(n, 0), step):
        part = b[at : at + step + length - 1]
        h = _hashes(part, gram)
        key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while 2 * s <= width:
            key, s = np.minimum(key[:-s], key[s:]), 2 * s
        k = len(part) - length + 1
        place = (np.minimum(key[:k], key[width - s : width - s + k]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[first]].view(np.int64), place[first] + at, first + at, np.concatenate([first[1:], [k]]) - 1 + at))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segment_id(place: int, segment: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(segment, digest_size=16, key=place.to_bytes(8, "little")).digest()


SEGMENTS = "digest binary, copies long, hash long, segment binary, place long, first long, last long"
SPLIT = SEGMENTS + ", parent binary, shift long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _segments(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, copies, content in zip(batch["digest"], batch["copies"], batch["content"], strict=True):
                text = bytes(content)
                for h, p, lo, hi in zip(*(x.tolist() for x in anchors(np.frombuffer(text, dtype=np.uint8), length)), strict=True):
                    out.append((digest, copies, h, _segment_id(p - lo, text[lo : hi + length]), p, lo, hi))
            yield pd.DataFrame(out, columns=_names(SEGMENTS))

    return run


def _split(length: int, width: int):
    """Segments of an anchor that too many have, in parts: of windows that have it at nearly the same place, grouped by the bytes that all of these cover."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, content, wanted in zip(batch["digest"], batch["content"], batch["wanted"], strict=True):
                text, out = bytes(content), []
                for w in wanted:
                    p, first, last = w["place"], w["first"], w["last"]
                    for c in range((p - last) // width, (p - first) // width + 1):
                        low, high = p - (c + 1) * width + 1, p - c * width
                        salt = w["hash"].to_bytes(8, "little", signed=True) + c.to_bytes(4, "little")
                        h = int.from_bytes(hashlib.blake2b(text[high : low + length], digest_size=8, salt=salt).digest(), "little", signed=True)
                        lo, hi = max(low, first), min(high, last)
                        out.append((digest, w["copies"], h, _segment_id(p - lo, text[lo : hi + length]), p, lo, hi, w["segment"], lo - first))
                yield pd.DataFrame(out, columns=_names(SPLIT))

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, wanted in zip(batch["content"], batch["wanted"], strict=True):
                text = bytes(content)
                for w in wanted:
                    out.append((w["hash"], w["segment"], w["place"] - w["first"], w["copies"], text[w["first"] : w["last"] + length]))
            yield pd.DataFrame(out, columns=["hash", "segment", "place", "copies", "bytes"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, wanted in zip(batch["content"], batch["wanted"], strict=True):
                text = bytes(content)
                out = [(w["segment"], i - w["first"], w["copies"], _segment_id(0, text[i : i + length])) for w in wanted for i in range(w["first"], w["last"] + 1)]
                yield pd.DataFrame(out, columns=["segment", "start", "copies", "window"])

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _shared_part(group: list[tuple[int, bytes]], length: int) -> list[tuple[int, int] | None]:
    """For segments (place of the anchor, bytes) of one group: the range of each that another may share, if it can hold a window."""
    reach = []
    for parts in ([s[p:] for p, s in group], [s[:p][::-1] for p, s in group]):
        most = [0] * len(parts)
        order = sorted(range(len(parts)), key=parts.__getitem__)
        for x, y in zip(order, order[1:], strict=False):
            c = _common(parts[x], parts[y])
            most[x], most[y] = max(most[x], c), max(most[y], c)
        reach.append(most)
    return [(p - left, p + right) if left + right >= length else None for (p, _), right, left in zip(group, *reach, strict=True)]


def _block(length: int) -> int:
    """Bytes of a block: a divisor of length near the root of it, so that rounds and symbols are few."""
    return max(d for d in range(1, length + 1) if length % d == 0 and d * d <= 2 * length)


def _symbols(b: np.ndarray, block: int) -> np.ndarray:
    """A number for the block at each place (too near the end: one of the zeros that follow), equal where the bytes are equal."""
    n, ids, s = len(b), b.astype(np.int64), 1
    padded = np.concatenate([ids, np.zeros(block, dtype=np.int64)])
    while s < block:
        step = min(s, block - s)
        both = padded[: n + block - s - step] * (padded.max() + 1) + padded[step : n + block - s]
        padded, s = np.unique(both, return_inverse=True)[1].astype(np.int64), s + step
    return padded[:n]


def repeated(segments: list[tuple[int, bytes, int]], length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For segments (place of the anchor, bytes, count): the starts in each of the strings of length that stand at two places or more, a count being places."""
    block = _block(length)
    depth = length // block
    every = np.frombuffer(b"".join(s for _, s, _ in segments), dtype=np.uint8)
    # blocks may not cross segments: those that would are left out below
    symbols = _symbols(every, block)
    bounds = np.cumsum([0, *(len(s) for _, s, _ in segments)])
    shards, owners, at = [], [], 0
    while at < len(segments):
        text, lengths, owner, size = [], [], [], 0
        while at < len(segments) and (not size or size < shard_bytes):
            lo, hi = int(bounds[at]), int(bounds[at + 1])
            for phase in range(min(block, hi - lo - block + 1)):
                own = symbols[lo + phase : hi - block + 1 : block]
                text.append(own)
                lengths.append(len(own))
                owner.append((at, phase))
            size += hi - lo
            at += 1
        shards.append(Shard(np.concatenate(text), np.array(lengths), depth))
        # of each place in the shard's text: the segment, and the byte there
        lengths = np.array(lengths)
        begin = np.cumsum(lengths + 1) - lengths - 1
        string = np.repeat(np.arange(len(lengths)), lengths + 1)
        inside = np.arange(int(lengths.sum()) + len(lengths)) - begin[string]
        owner = np.array(owner)
        owners.append((owner[string, 0], owner[string, 1] + inside * block))
    places, prefix = merge(shards, depth)
    segment, start = (np.concatenate(x)[places] for x in zip(*owners, strict=True))
    interval = np.cumsum(prefix < depth) - 1
    counts = np.array([c for _, _, c in segments], dtype=np.int64)
    again = np.bincount(interval, weights=counts[segment])[interval] > 1
    sizes = np.diff(bounds)
    again &= start + length <= sizes[segment]
    order = np.flatnonzero(again)
    order = order[np.lexsort((start[order], segment[order]))]
    cuts = np.searchsorted(segment[order], np.arange(1, len(segments)))
    return np.split(start[order], cuts)


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive starts."""
    if not len(starts):
        return [], []
    new = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], new + 1])].tolist(), starts[np.concatenate([new, [len(starts) - 1]])].tolist()


VERDICTS = "segment binary, firsts array<long>, lasts array<long>"


def _judge(length: int):
    """Groups come whole, one after the other; what they share is merged about BATCH_BYTES at a time."""

    def judged(pending: list[tuple[tuple[int, bytes, int], list[tuple]]]) -> pd.DataFrame:
        out = []
        for starts, (_, members) in zip(repeated([w for w, _ in pending], length) if pending else [], pending, strict=True):
            if len(starts):
                # one at two places or more is gone as a whole already
                for row, left in (m for m in members if m[0][3] == 1):
                    out.append((row[1], *_ranges(starts + left)))
        return pd.DataFrame(out, columns=_names(VERDICTS))

    def shared_parts(group: list[tuple]) -> list[tuple[tuple[int, bytes, int], list[tuple]]]:
        parts = _shared_part([(p, s) for _, _, p, _, s in group], length)
        same: dict[tuple[int, bytes], list[int]] = {}
        for i, part in enumerate(parts):
            if part:
                same.setdefault((group[i][2] - part[0], group[i][4][part[0] : part[1]]), []).append(i)
        return [((p, s, sum(group[i][3] for i in members)), [(group[i], parts[i][0]) for i in members]) for (p, s), members in same.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        pending, size = [], 0
        for b in batches:
            for row in zip(b["hash"], b["segment"], b["place"], b["copies"], map(bytes, b["bytes"]), strict=True):
                if group and group[0][0] != row[0]:
                    found = shared_parts(group)
                    pending, size, group = pending + found, size + sum(len(w[1]) for w, _ in found), []
                    if size > BATCH_BYTES:
                        yield judged(pending)
                        pending, size = [], 0
                group.append(row)
        yield judged(pending + (shared_parts(group) if group else []))

    return run


RESULT = "digest binary, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, copies, content, ranges in zip(batch["digest"], batch["copies"], batch["content"], batch["ranges"], strict=True):
                text = bytes(content)
                gone = np.zeros(len(text) + 1, dtype=np.int64)
                if copies > 1 and len(text) >= length:
                    gone[0], gone[-1] = 1, -1
                for r in ranges if ranges is not None else ():
                    gone[r["first"]] += 1
                    gone[r["last"] + length] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if spans else text
                out.append((digest, len(text), int(gone.sum()), spans, kept))
            yield pd.DataFrame(out, columns=_names(RESULT))

    return run


def _distinct(docs: DataFrame, digest, content, name: str) -> DataFrame:
    """Distinct texts with their copies, as a table in buckets by digest, so that later joins move no text."""
    spark = docs.sparkSession
    # as many buckets as a shuffle has partitions: then neither this one nor the joins to come move the texts again
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(digest.alias("digest"), content.cast("binary").alias("content"))
    rows = rows.groupBy("digest").agg(F.first("content").alias("content"), F.count("*").alias("copies"))
    rows.write.option("compression", "zstd").bucketBy(n, "digest").saveAsTable(name)
    return spark.table(name)


class _Work:
    """Tables of one run, dropped at its end, also when it fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.saved, self.tables = spark, [], []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved.append(shared.save(df, name))
        return self.saved[-1]

    def clear(self) -> None:
        for x in self.saved:
            shared.drop(x)
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")


def _members(work: _Work, found: DataFrame, length: int) -> DataFrame:
    """Distinct segments that are at two places or share their hash with another: hash, segment, copies, at, kinds, and size, the bytes of their group."""
    one = found.groupBy("hash", "segment").agg(F.sum("copies").alias("copies"), F.min(F.struct("digest", "place", "first", "last")).alias("at"))
    one = work.save(one, "distinct-segments")
    size = F.sum(F.col("at.last") - F.col("at.first") + length)
    groups = one.groupBy("hash").agg(F.count("*").alias("kinds"), F.sum("copies").alias("places"), size.alias("size")).where("places > 1")
    return work.save(one.join(groups.drop("places"), "hash").where("copies > 1 or kinds > 1"), "shared-segments")


def _with_texts(member: DataFrame, long: DataFrame) -> DataFrame:
    sought = F.collect_list(F.struct("hash", "segment", "place", "first", "last", "copies")).alias("wanted")
    rows = member.select("hash", "segment", "copies", "at.*").groupBy("digest").agg(sought)
    return long.join(rows.hint("shuffle_hash"), "digest")


def _merged(member: DataFrame, long: DataFrame, length: int) -> DataFrame:
    """Verdicts of groups that one task can merge."""
    cut = _with_texts(member, long).mapInPandas(_cut(length), "hash long, segment binary, place long, copies long, bytes binary")
    return cut.repartition("hash").sortWithinPartitions("hash", "segment").mapInPandas(_judge(length), VERDICTS)


def _whole(member: DataFrame) -> DataFrame:
    """Segments at two places or more are repeated as a whole; of the others the judged ones are, in part."""
    none = F.lit(None).cast("array<long>")
    return member.where("copies > 1").select("segment", F.lit(True).alias("whole"), none.alias("firsts"), none.alias("lasts"))


def _ranges_of(first, last):
    """What a verdict says of a segment whose windows start from first to last."""
    return F.when(F.col("whole"), F.array(F.struct(first.alias("first"), last.alias("last")))).otherwise(
        F.transform(F.arrays_zip("firsts", "lasts"), lambda x: F.struct((x["firsts"] + first).alias("first"), (x["lasts"] + first).alias("last")))
    )


def _dense(work: _Work, member: DataFrame, long: DataFrame, length: int, group_bytes: int, width: int) -> DataFrame:
    """Verdicts of groups that are too large for a task: in parts, and the windows of parts that still are by their digests."""
    split = work.save(_with_texts(member, long).mapInPandas(_split(length, width), SPLIT), "split-segments")
    inner = _members(work, split.select(*_names(SEGMENTS)), length)
    judged = _merged(inner.where((F.col("kinds") > 1) & (F.col("size") <= group_bytes)), long, length)
    large = inner.where((F.col("kinds") > 1) & (F.col("size") > group_bytes))
    if not large.isEmpty():
        windows = work.save(_with_texts(large, long).mapInPandas(_windows(length), "segment binary, start long, copies long, window binary"), "windows")
        again = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
        starts = windows.where("copies = 1").join(again, "window", "left_semi").groupBy("segment").agg(F.collect_set("start").alias("firsts"))
        judged = judged.unionByName(starts.withColumn("lasts", F.col("firsts")))
    verdicts = work.save(_whole(inner).unionByName(judged.withColumn("whole", F.lit(False))), "split-verdicts")
    # of segments at two places all is known
    back = split.where("copies = 1").select("segment", "parent", "shift", (F.col("last") - F.col("first")).alias("n")).join(verdicts, "segment")
    parts = back.select(F.col("parent").alias("segment"), F.explode(_ranges_of(F.col("shift"), F.col("shift") + F.col("n"))).alias("r"))
    return parts.groupBy("segment").agg(F.collect_list("r").alias("r")).select("segment", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))


def remove_repeats(docs: DataFrame, length: int = 400, group_bytes: int = GROUP_BYTES, key: str = "doc_id", text: str = "text", derive: dict | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, and derive's columns) of each row.

    A text is its UTF-8 bytes (null: empty). n_removed counts the bytes that are covered by a string of length bytes
    which starts at another place too, of any row, the same one included; n_spans counts their maximal runs. derive:
    columns by name over kept (binary), the bytes that stay; by default kept itself. Rows with equal texts of length
    bytes or more lose them all. Null and repeated keys are rows like others. An empty table gives an empty table.

    group_bytes: different segments of one anchor hash that are more than that are not merged in one task. They are
    split by the anchor's place in a window, about the root of length of them together, and by what their windows
    share; a part that is still larger has its windows counted by 128-bit digests across tasks. All give the same.
    """
    spark: SparkSession = docs.sparkSession
    shared.prepare(spark)
    derive = {"kept": F.col("kept")} if derive is None else derive
    content = shared.text_or_empty(text)
    digest = F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 32))
    work = _Work(spark)
    try:
        name = f"quire_texts_{uuid.uuid4().hex}"
        work.tables.append(name)
        texts = _distinct(docs, digest, content, name)
        long = texts.where(F.octet_length("content") >= length)
        found = work.save(long.mapInPandas(_segments(length), SEGMENTS), "segments")
        member = _members(work, found, length)
        judged = _merged(member.where((F.col("kinds") > 1) & (F.col("size") <= group_bytes)), long, length)
        large = member.where((F.col("kinds") > 1) & (F.col("size") > group_bytes))
        if not large.isEmpty():
            judged = judged.unionByName(_dense(work, large, long, length, group_bytes, _block(length)))
        verdicts = work.save(_whole(member).unionByName(judged.withColumn("whole", F.lit(False))), "verdicts")
        # a segment's digest holds its anchor's place and its bytes, and so its group; one join, whose skewed keys can be split
        marked = found.select("digest", "segment", "first", "last").join(verdicts, "segment")
        ranges = marked.select("digest", F.explode(_ranges_of(F.col("first"), F.col("last"))).alias("r")).groupBy("digest").agg(F.collect_list("r").alias("ranges"))
        result = texts.join(ranges.hint("shuffle_hash"), "digest", "left").mapInPandas(_remove(length), RESULT)
        result = shared.save(result.select("digest", "n_bytes", "n_removed", "n_spans", *[c.alias(k) for k, c in derive.items()]), "kept")
    finally:
        work.clear()
    return docs.select(F.col(key), digest.alias("digest")).join(result, "digest").drop("digest")
