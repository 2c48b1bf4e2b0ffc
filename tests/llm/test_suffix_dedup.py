"""Repeated strings against a plain count of all strings."""

import collections
import hashlib
import random

import numpy as np
import pytest

from quire.llm.bwt import Shard, merge
from quire.llm.suffix_dedup import anchors, remove_repeats, repeated


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    texts = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_merged_transforms_are_in_order(depth):
    rng = np.random.default_rng(depth)
    strings = [rng.integers(0, 3, rng.integers(1, 25)) for _ in range(30)]
    shards, texts = [], []
    for i in range(0, 30, 10):
        own = strings[i : i + 10]
        shards.append(Shard(np.concatenate(own), np.array([len(s) for s in own]), depth))
        texts += [(tuple(s[j:].tolist()), i + k) for k, s in enumerate(own) for j in range(len(s) + 1)]
    places, prefix = merge(shards, depth)
    got = [texts[i] for i in places.tolist()]

    def key(x):
        # a suffix that ends within the depth ends in its string's own sentinel
        s, owner = x
        return [(1, c) for c in s[:depth]] + ([(0, owner)] if len(s) < depth else [])

    assert [key(x) for x in got] == sorted(map(key, got))
    for i in range(1, len(got)):
        a, b = key(got[i - 1]), key(got[i])
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix[i] == min(same, depth)


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(3)
    b = rng.integers(97, 100, 3000).astype(np.uint8)
    h, p, lo, hi = anchors(b, 400)
    assert lo[0] == 0 and hi[-1] == len(b) - 400 and (lo[1:] == hi[:-1] + 1).all()
    assert ((p >= hi) & (p + 32 <= lo + 400)).all()


def test_repeated_of_small_segments():
    a, b = b"x" * 10 + b"abcdefghijklmnopqrstuvwxyz" * 2, b"abcdefghijklmnopqrstuvwxyz" * 2 + b"yy"
    starts = repeated([(0, a, 1), (0, b, 1)], 20, 10)
    expected = [[i for i in range(len(s) - 19) if (a + b"|" + b).count(s[i : i + 20]) > 1 or sum(t[j : j + 20] == s[i : i + 20] for t in (a, b) for j in range(len(t) - 19)) > 1] for s in (a, b)]
    assert [s.tolist() for s in starts] == expected


@pytest.mark.parametrize("length", [64, 400])
def test_made_up_texts(spark, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(length // 8, length))) for _ in range(4)]
    texts = [None, "", "a" * (3 * length), "ab" * length, "z" * (length - 1), "z" * (length - 1)]
    for i in range(60):
        own = " ".join(word() for _ in range(rng.randint(5, 200)))
        if i % 3 == 0:
            own += rng.choice(passages) + " ".join(word() for _ in range(20))
        if i % 7 == 0:
            own = rng.choice(passages)[rng.randint(0, 60) :] + own
        texts.append(own)
    base = texts[10]
    texts += [base, base, base[:100] + "#" + base[100:], passages[0] + passages[0]]
    for _ in range(12):
        at = rng.randint(0, len(passages[1]))
        texts.append(passages[1][:at] + word() + passages[1][at:])
    docs = spark.createDataFrame([(i if i % 5 else None, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs, length).collect()]
    expected = [(i if i % 5 else None, *x) for i, x in enumerate(plain(texts, length))]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert remove_repeats(docs.limit(0), length).count() == 0
    for group_bytes in (1, 3 * length, 20 * length):
        split = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs, length, group_bytes).collect()]
        assert sorted(split, key=str) == sorted(expected, key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in remove_repeats(docs).collect()}
    expected = {r["doc_id"]: (a, b, c, hashlib.sha256(k).hexdigest()) for r, (a, b, c, k) in zip(rows, plain([r["text"] for r in rows], 400))}
    assert got == expected
