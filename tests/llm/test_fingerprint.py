"""Fingerprints: entropies against a plain sum, neighbours against a plain order, likeness of edits."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import fingerprint as fp


def plain_entropy(window):
    counts = Counter(window)
    return -sum(c / 64 * math.log2(c / 64) for c in counts.values()) / 6 * fp.STEPS


def test_entropies():
    rng = np.random.default_rng(2)
    b = np.concatenate([rng.integers(0, 255, 300), np.zeros(100, int), rng.integers(97, 101, 300)]).astype(np.uint8)
    got = fp.entropies(b)
    for i in range(len(b) - 63):
        assert abs(got[i] - plain_entropy(b[i : i + 64].tolist())) < 1 + 1e-6


def ranks():
    r = np.arange(fp.STEPS + 2)
    r[: fp.LEAST] = fp.STEPS + 1
    return r


def plain_features(b, r):
    n = len(b) - 63
    e = [int(r[x]) for x in fp.entropies(np.frombuffer(b, dtype=np.uint8))]
    chosen = Counter(min(range(i, i + 64), key=lambda j: (e[j], j)) for i in range(n - 63))
    return [i for i in sorted(chosen) if chosen[i] >= fp.CHOSEN and e[i] < r[-1]]


def test_features_are_those_chosen_often():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (400, 1000, 130, 64, 10, 0)]
    got = fp.features(texts, ranks())
    assert [len(g) for g in got[:2]] == [len(plain_features(t, ranks())) for t in texts[:2]]
    assert [len(g) for g in got[3:]] == [1, 1, 0]
    alone = [fp.features([t], ranks())[0].tolist() for t in texts]
    assert [g.tolist() for g in got] == alone


def test_likeness():
    rng = np.random.default_rng(5)
    a, b = (bytes(rng.integers(97, 120, 20_000).astype(np.uint8)) for _ in range(2))
    mixed = a[:14_000] + b[:6_000]
    x, y, m, none = (fp._filters(h) for h in fp.features([a, b, mixed, b""], ranks()))
    assert fp.likeness(x, x) == 1 and fp.likeness(none, none) == 1 and fp.likeness(x, none) == 0
    assert fp.likeness(x, y) < 0.05 < 0.3 < fp.likeness(x, m) < 1
    assert [v.tolist() for v in fp.decoded(fp.encoded(*x))] == [v.tolist() for v in x]


def plain_filters(b, r):
    """Sets of bits with the features in each, from windows chosen one by one."""
    if len(b) < 64:
        found = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")] if b else []
    else:
        e = [int(r[x]) for x in fp.entropies(np.frombuffer(b, dtype=np.uint8))]
        rounds = range(max(1, len(e) - 63))
        chosen = Counter(min(range(i, min(i + 64, len(e))), key=lambda j: (e[j], j)) for i in rounds)
        often = [i for i in sorted(chosen) if chosen[i] >= min(fp.CHOSEN, max(1, len(e) - 63))]
        at = [i for i in often if e[i] < r[-1]] or often[:1] or [min(range(min(64, len(e))), key=lambda j: (e[j], j))]
        found = []
        for i in at:
            h = sum(c * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(b[i : i + 64])) % (1 << 64)
            h ^= h >> 31
            h = h * 0xD6E8FEB86659FD93 % (1 << 64)
            h ^= h >> 32
            if h not in found:
                found.append(h)
    groups = [found[i : i + fp.FULL] for i in range(0, len(found), fp.FULL)]
    return [({(h >> 11 * k) % fp.BITS for h in g for k in range(fp.SET)}, len(g)) for g in groups]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = sorted((a, b), key=len)
    best = []
    for x, n in a:
        scores = []
        for y, m in b:
            most = min(len(x), len(y))
            q = 1 - 1 / fp.BITS
            chance = min(most, fp.BITS * (1 - q ** (fp.SET * n)) * (1 - q ** (fp.SET * m)))
            cut = chance + fp.CUT * (most - chance)
            scores.append(1.0 if len(x & y) >= most else max(0.0, (len(x & y) - cut) / (most - cut)) if most > cut else 0.0)
        best.append(max(scores))
    return sum(best) / len(best)


@pytest.mark.parametrize("parts", [None, 1, 23])
def test_neighbours_of_a_table(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fp.compare_with_edits(docs.repartition(3), parts).collect()}
    assert len(got) == len(texts)
    for (d, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        k = len(t) // 3
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= got[d]["near_next"] <= 1 and 0 <= got[d]["near_edited"] <= 1
    known = fp.entropy_ranks(docs)
    plain = lambda t: plain_filters(t.encode(), known)
    for (d, t), (_, after) in list(zip(texts, texts[1:] + texts[:1]))[::5]:
        k = len(t) // 3
        own = plain(t)
        assert got[d]["near_next"] == pytest.approx(plain_likeness(own, plain(after)))
        assert got[d]["near_edited"] == pytest.approx(plain_likeness(own, plain(t[: len(t) - k] + after[:k])))
    long = [r for r in got.values() if r["n_chars"] > 2000]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in long])
    by_text = {}
    for d, t in texts:
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "abc" * 500, "y"), (7, "é" * 90_000, "z"), (5, "", "y"), (None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = fp.compare_with_edits(docs, 2).collect()
    assert sorted(str((r["doc_id"], r["n_chars"])) for r in got) == sorted(str((d, len(t or ""))) for d, t, _ in rows)
    last = next(r for r in got if r["n_chars"] == 90_000)
    assert last["edited_sha256"] == hashlib.sha256(("é" * 60_000).encode()).hexdigest()
    assert fp.compare_with_edits(docs.limit(0)).count() == 0
    assert len(fp.compare_with_edits(docs.where("doc_id = 5")).collect()) == 1


def test_a_key_of_most_rows_is_dealt_out(spark):
    rows = [(5 if i % 3 else None, f"text {i} " * (1 + i % 40)) for i in range(300)] + [(i, f"other {i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    expected = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        expected.append((d, hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    for parts in (1, 40):
        got = [(r["doc_id"], r["edited_sha256"]) for r in fp.compare_with_edits(docs, parts).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
