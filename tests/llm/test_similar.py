"""Similar texts: against the shingles of all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from quire.llm.simhash import wide_fingerprint
from quire.llm.similar import allowed, chosen, keep_one, meeting, similar, sketch, spanning

SCHEMA = "doc_id long, text string, source string"
MASK = (1 << 64) - 1


def plain_wide(text, k=5, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    out = []
    for j in range(width):
        mixed = []
        for h in hashes:
            if j:
                h = h + j * 0x9E3779B97F4A7C15 & MASK
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
                h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
                h ^= h >> 31
            mixed.append(h)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return out


def joined(keys, linked):
    root = {d: d for d in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in root}


def plain_ids(texts, least=0.8):
    """The component of each key, from all pairs of sets of shingles."""
    sets = {d: plain_set(t) for d, t in texts.items()}
    return joined(texts, lambda a, b: jaccard(sets[a], sets[b]) >= least)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return words


def table(rng):
    line = [f"line{i}" for i in range(30)]
    rows = [(1, "", "x"), (2, None, "x"), (3, "one two", "x"), (4, "ONE  two", "x"), (5, "one two three", "x")]
    for size in (12, 60, 200, 700):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)] + line
            for n in (0, 1, 1, 2, 3, 4, 6, size // 30, size // 25):
                rows.append((len(rows) + 10, " ".join(varied(rng, base, n)), "x"))
    group = [f"g{i}" for i in range(150)]
    rows += [(len(rows) + 10 + i, " ".join(varied(rng, group, rng.randrange(1, 4))), "x") for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("text", ["", " ", "one", "a b c d", "One TWO three four five six", "ÄÖ é x\ty\nz " * 3, "a b c " * 400])
def test_wide_fingerprint(text):
    assert wide_fingerprint(text) == plain_wide(text)


def test_allowed_bits():
    assert allowed(0.8, 128) == 29 and allowed(1.0, 128) == 0


@pytest.mark.parametrize("seed", range(6))
def test_spanning_forest_of_least_scores(seed):
    rng = np.random.default_rng(seed)
    a, b, score = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 50, 300).astype(np.uint64)
    a, b, score = a[a != b], b[a != b], score[a != b]
    got = spanning(a, b, score)
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = n = 0
    for k in np.lexsort((np.arange(len(a)), score)):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[y] = x
            total, n = total + int(score[k]), n + 1
    assert len(got) == n and int(score[got].sum()) == total


@pytest.mark.parametrize("most", [1, 3, 50])
def test_chosen(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    a, b = a[a != b], b[a != b]
    size, bits = rng.integers(1, 4, 40), rng.permutation(1600)
    score = bits[np.minimum(a, b) * 40 + np.maximum(a, b)]
    of = {x: sorted({(int(n), int(min(p, q)), int(max(p, q))) for p, q, n in zip(a, b, score) if x in (p, q) and size[x] <= size[p + q - x]})[:most] for x in range(40)}
    places, owners = chosen(a, b, size[a], size[b], score, most)
    assert sorted((int(o), int(min(a[k], b[k])), int(max(a[k], b[k]))) for k, o in zip(places, owners)) == sorted((x, p, q) for x, few in of.items() for _, p, q in few)


def test_all_pairs(spark):
    rows = table(random.Random(4))
    texts = {d: t for d, t, _ in rows}
    expected, sets = plain_ids(texts), {d: plain_set(t) for d, t in texts.items()}
    got = similar(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows) and len(set(expected.values())) < len(rows) - 60
    # no link that is not similar, and hardly one that is lost
    assert all(expected[d] == expected[c] for d, c in found.items())
    pairs = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert similar(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dense", [7, 1])
def test_blocks_of_dense_values_lose_nothing(spark, dense):
    rows = table(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {(r["doc_id"], r["component_id"]) for r in similar(df).collect()}
    assert {(r["doc_id"], r["component_id"]) for r in similar(df, dense=dense).collect()} == whole


def test_links_are_those_of_similar_sets(spark):
    rng = random.Random(9)
    texts, similarity = {}, {}
    for i in range(0, 1000, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 400))]
        texts[i], texts[i + 1] = " ".join(base), " ".join(varied(rng, base, rng.randrange(1, len(base) // 18)))
        similarity[i] = jaccard(plain_set(texts[i]), plain_set(texts[i + 1]))
    got = {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame([(d, t, "x") for d, t in texts.items()], SCHEMA)).collect()}
    found = {i: got[i + 1] == i for i in similarity}
    assert all(got[i] == i for i in similarity)
    close = [found[i] for i, s in similarity.items() if 0.8 <= s < 0.85]
    like = [found[i] for i, s in similarity.items() if s >= 0.8]
    below = [found[i] for i, s in similarity.items() if 0.75 <= s < 0.8]
    assert len(close) > 40 and sum(close) >= 0.93 * len(close) and sum(like) >= 0.96 * len(like)
    assert len(below) > 40 and not any(found[i] for i, s in similarity.items() if s < 0.8)


def test_the_pipeline_drops_copies_beyond_three_bits(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    while True:
        other = varied(rng, base, 1)
        a, b = wide_fingerprint(" ".join(base)), wide_fingerprint(" ".join(other))
        if (a[0] ^ b[0]).bit_count() > 3 and jaccard(plain_set(" ".join(base)), plain_set(" ".join(other))) >= 0.8:
            break
    rows = [(7, " ".join(base), "x"), (3, " ".join(other), "x"), (9, "another text", "x"), (None, "another text", "x"), (9, "another text", "x"), (11, None, "x"), (12, "", "x")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["11", "3", "9", "None"]
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_link_is_lost_near_the_bound(spark):
    # pairs, and groups in which each text is near the bound of most others
    rng = random.Random(12)
    texts = {}
    for _ in range(250):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        for words in (base, varied(rng, base, max(1, len(base) // 45))):
            texts[len(texts)] = " ".join(words)
    for _ in range(4):
        base = [f"g{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(60):
            texts[len(texts)] = " ".join(varied(rng, base, rng.randrange(3, 6)))
    got = {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame([(d, t, "x") for d, t in texts.items()], SCHEMA)).collect()}
    assert got == plain_ids(texts)


@pytest.mark.parametrize("least, dense", [(0.5, 4096), (0.8, 16), (0.9, 4096), (1.0, 4096)])
def test_all_links_of_a_table(spark, least, dense):
    rows = table(random.Random(13))
    got = {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame(rows, SCHEMA), least=least, dense=dense).collect()}
    assert got == plain_ids({d: t for d, t, _ in rows}, least)


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_sketches_rule_out_nothing_similar(least):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 900)
    sets = [np.unique(np.concatenate([base[rng.random(900) < rng.uniform(0.05, 1)], rng.integers(-(2**63), 2**63 - 1, rng.integers(1, 60))])) for _ in range(80)]
    size, label = np.array([len(s) for s in sets]), rng.integers(0, 30, 80)
    entry, fresh = rng.random(80) < 0.6, rng.random(80) < 0.8
    got = [(min(i, j), max(i, j)) for a, b, _ in meeting(size, label, [sketch(s) for s in sets], entry, fresh, least) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    like = {(i, j) for i, j in itertools.combinations(range(80), 2) if label[i] != label[j] and (entry[i] or entry[j]) and (fresh[i] or fresh[j]) and jaccard(set(sets[i]), set(sets[j])) >= least}
    assert len(got) == len(set(got)) and like and like <= set(got)
    assert all(label[i] != label[j] and (entry[i] or entry[j]) and (fresh[i] or fresh[j]) for i, j in got)
