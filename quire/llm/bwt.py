"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

Strings are arrays of symbols (integers from 0). Each string ends in a sentinel of its own, smaller than all symbols
and smaller than the sentinels of later strings. A shard's transform comes from sorting its suffixes by prefix
doubling; merging starts with the shards one after the other and, in each round, sends every entry of the
transforms to the place of the suffix one symbol longer, by a stable distribution. After k rounds the interleave is
right for prefixes of k symbols; where a boundary first appears tells the common prefix there. Suffixes themselves
are never compared or sorted again.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Transform of some strings, given one after the other in text with the length of each."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, depth: int):
        m, n = len(lengths), int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        whole = np.empty(n, dtype=np.int64)
        sentinel = np.zeros(n, dtype=bool)
        sentinel[ends] = True
        whole[~sentinel] = text + m
        whole[ends] = np.arange(m)
        rank = np.unique(whole, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank, kind="stable")
        k = 1
        while k < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            keys = rank * (n + 1) + after
            order = np.argsort(keys, kind="stable")
            first = np.ones(n, dtype=bool)
            first[1:] = keys[order[1:]] != keys[order[:-1]]
            rank[order] = np.cumsum(first) - 1
            k *= 2
        self.strings, self.suffixes = m, order
        #: What stands before each suffix: a symbol, or -1 where a string begins.
        before = whole[order - 1] - m
        start = np.zeros(n, dtype=bool)
        start[0] = True
        start[ends[:-1] + 1] = True
        before[start[order]] = -1
        self.bwt = before


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys below 2**32, by two distributions over 16 bits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first depth symbols: the place of each in the shards' texts, one after the other, and common prefix with the one before, up to depth.

    Work is rounds times entries, whatever the number of shards (below 65,536): the transforms lie one after the other,
    and one stable sort of the interleave gives the entry at each of its places.
    """
    m, sizes = sum(s.strings for s in shards), [len(s.bwt) for s in shards]
    n = sum(sizes)
    bwt = np.concatenate([s.bwt for s in shards]).astype(np.int32)
    # sentinels come first and stay where they are, in the order of the shards
    fixed = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.strings for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    block = np.zeros(n, dtype=np.int32)
    prefix = np.full(n, -1, dtype=np.int32)
    prefix[0] = 0
    entry = np.empty(n, dtype=np.int64)
    for k in range(1, depth + 1):
        entry[np.argsort(z, kind="stable")] = np.arange(n)
        symbols = bwt[entry]
        inner = np.flatnonzero(symbols >= 0)
        order = inner[_stable(symbols[inner])]
        first = np.ones(n, dtype=bool)
        a, b = symbols[order], block[order]
        first[m + 1 :] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        z = np.concatenate([fixed, z[order]])
        block = np.cumsum(first, dtype=np.int32) - 1
        prefix[first & (prefix < 0)] = k - 1
    prefix[prefix < 0] = depth
    entry[np.argsort(z, kind="stable")] = np.arange(n)
    begin = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    return (np.concatenate([s.suffixes for s in shards]) + begin)[entry], prefix
