"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Two fingerprints within the distance differ in one segment by at most
distance div segments bits. Each distinct fingerprint stands in a table by each segment's value, and probes it with
the values of a small Hamming ball around its own; complete distances are verified where a probe meets an entry.
Of two values that probe each other only the smaller probes. Equal fingerprints are one entry, whatever their rows.

A segment value with more than dense entries is looked up by a second level: entries and probes take as a further
key the values of balls around the rest of their bits, whose radii add up to what distance is left; all that meet
there are within the distance, so each needs a link with one of them only, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components

BITS = 64
#: Shingles whose bits are counted at a time.
CHUNK = 50_000


def _hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's word shingles, repeats included, CHUNK at a time."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    k = min(words, len(found))
    n = len(found) - k + 1
    for i in range(0, n, CHUNK):
        yield np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts[i : min(i + CHUNK, n)], ends[i + k - 1 : min(i + CHUNK, n) + k - 1])], dtype="<u8")


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: eight counters, a byte each, in one number, for up to 255 hashes at a time."""
    spread = (h[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(0x0101010101010101)
    at = np.arange(0, len(h), 255)
    return np.add.reduceat(spread, at, axis=0).view(np.uint8).reshape(len(at), 8, 8).sum(axis=0, dtype=np.int64).T.reshape(BITS)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash that is derived from each hash; the first is the hash itself."""
    if not j:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: str, words: int = 5, width: int = 4, seed: int = 42) -> list[int]:
    """Unsigned SimHash of width times 64 bits over word shingles, 64 bits a number; zeros for a text without words."""
    votes, n = np.zeros((width, BITS), dtype=np.int64), 0
    for h in _hashes(text, words, seed):
        n += len(h)
        for j in range(width):
            votes[j] += _votes(_mixed(h, j))
    return [int.from_bytes(np.packbits(2 * v > n, bitorder="little").tobytes(), "little") for v in votes]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles; 0 for a text without words."""
    return wide_fingerprint(text, words, 1, seed)[0]


def _fingerprints(key: str, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.array([fingerprint(t, words) for t in b["content"]], dtype=np.uint64)
            yield pd.DataFrame({key: b[key], "fp": got.view(np.int64)})

    return run


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of each row; fp holds the 64 bits. Null text counts as empty."""
    shared.prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("fp", T.LongType())])
    out = docs.select(shared.key_text(key), shared.text_or_empty(text).alias("content")).mapInPandas(_fingerprints(key, words), schema)
    return out.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def _masks(width: int, radius: int, least: int = 0) -> list[int]:
    return [sum(1 << i for i in c) for r in range(least, radius + 1) for c in combinations(range(width), r)]


def _ball(values: list[int]):
    return F.array(*[F.lit(x).cast("long") for x in values])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (a, b) join, one for each value but the least of each group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _within(run: np.ndarray, probe: np.ndarray, node: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what linked pairs of a run join; in a run entries come first, and a pair holds an entry at least. near(i, j): whether rows link."""
    found_a, found_b, held, n = [], [], 0, len(node)
    i = np.flatnonzero(~probe)
    k = 1
    while len(i):
        i = i[i + k < n]
        i = i[run[i] == run[i + k]]
        linked = i[near(i, i + k)]
        found_a.append(node[linked])
        found_b.append(node[linked + k])
        held += len(linked)
        if held > 2_000_000:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], len(a)
        k += 1
    if not held:
        return node[:0], node[:0]
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _links(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            now = [b["seg"].to_numpy(), b["value"].to_numpy(), b["probe"].to_numpy() > 0, b["fp"].to_numpy().view(np.uint64)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            seg, value, probe, fp = now
            if not len(fp):
                continue
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (seg[1:] != seg[:-1]) | (value[1:] != value[:-1])
            # the last run may go on: its entries are kept, which an earlier step has bounded; its probes are done
            last = int(np.flatnonzero(new)[-1])
            a, c = _within(np.cumsum(new), probe, fp, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= distance)
            kept = [x[last:][~probe[last:]] for x in now]
            yield pd.DataFrame({"a": a.view(np.int64), "b": c.view(np.int64)})

    return run


def links(fps: DataFrame, distance: int = 3, segments: int = 2, dense: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly the distinct values of fps.fp which chains of distances up to distance connect."""
    spark = fps.sparkSession
    width, radius = BITS // segments, distance // segments
    low = (1 << width) - 1
    segment = [F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit(low).cast("long")) for s in range(segments)]
    around = _masks(width, radius, 1)
    entries = fps.select("fp", F.posexplode(F.array(*segment)).alias("seg", "value"))
    flips = F.transform(_ball([0, *around]), lambda m: F.struct(F.col("value").bitwiseXOR(m).alias("value"), F.bit_count(m).cast("int").alias("probe")))
    # of two values that differ, the smaller probes the greater
    rows = entries.select("fp", "seg", F.explode(F.filter(flips, lambda x: x["value"] >= F.col("value"))).alias("x")).select("seg", "x.value", "x.probe", "fp")
    hot = shared.save(entries.groupBy("seg", "value").count().where(F.col("count") > dense).select("seg", "value"), "dense")
    some = not hot.isEmpty()
    cold = rows.join(hot, ["seg", "value"], "left_anti") if some else rows
    out = cold.repartition("seg", "value").sortWithinPartitions("seg", "value", "probe").mapInPandas(_links(distance), "a long, b long")
    if not some:
        return out
    # the second level: the other bits are one number, of which balls are taken in each of its segments
    small, big = distance // 2, distance - distance // 2
    rest_bits = BITS - width
    dense_rows = rows.join(hot, ["seg", "value"], "left_semi")
    parts = []
    for s in range(segments):
        mine = [i for i in range(BITS) if not width * s <= i < width * (s + 1)]
        assert len(mine) == rest_bits
        clear = ~(low << (width * s)) & (1 << BITS) - 1
        clear -= (clear >> 63) << 64
        for probe in range(radius + 1):
            reach = big if probe == 0 else distance - probe - small
            if reach < 0:
                continue
            masks = [sum(1 << mine[i] for i in c) for r in range(reach + 1) for c in combinations(range(rest_bits), r)]
            signed = [m - ((m >> 63) << 64) for m in masks]
            near = F.transform(_ball(signed), lambda m: F.struct(m.bitwiseXOR(F.col("fp").bitwiseAND(F.lit(clear).cast("long"))).alias("sub"), (F.bit_count(m) <= small).alias("inner")))
            part = dense_rows.where((F.col("seg") == s) & (F.col("probe") == probe)).select("seg", "value", "fp", F.explode(near).alias("x"))
            parts.append(part.select("seg", "value", "fp", "x.sub", (F.col("x.inner") & F.lit(probe == 0)).alias("inner")))
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    centre = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("seg", "value", "sub"))
    second = met.select(F.col("fp").alias("a"), centre.alias("b")).where("b is not null and a <> b").distinct()
    return out.union(second)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, segments: int = 2, dense: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each row: component_id is the smallest key that chains of links reach from it.

    Texts link whose fingerprints differ in distance bits or fewer. Texts without words have fingerprint 0 and link as
    others do; null text counts as empty. Repeated rows each keep a row. A null key is never a component's id, unless
    all its keys are null. An empty table gives an empty table. Other columns are ignored.
    """
    held = shared.save(fingerprints(docs, words, key, text), "fingerprints")
    distinct = shared.save(held.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    group = components(links(distinct.select("fp"), distance, segments, dense))
    labelled = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "component_id")
    return held.join(by_fp, "fp").select(key, "fp", "component_id")
