"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from quire.llm.components import components
from quire.llm.simhash import fingerprint, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    out = {}
    for v in values:
        out.setdefault(find(v), set()).add(v)
    return sorted(sorted(g) for g in out.values())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "  ", "one", "one two", "One TWO three four", "ÄÖ é x\ty\nz", "a b c " * 400])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("dense", [4096, 2])
def test_links_connect_what_all_pairs_connect(spark, dense):
    rng = random.Random(5)
    values = [0, (1 << 64) - 1]
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = components(links(df, 3, 2, dense)).collect()
    by = {}
    for r in found:
        by.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    expected = [g for g in groups(values, 3) if len(g) > 1]
    assert sorted(sorted(g) for g in by.values()) == expected


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base, "x"), (3, base, "y"), (None, base, "z"), (9, None, "x"), (8, "", "x"), (5, base.upper(), "x"), (5, base.upper(), "x"), (11, "quite another text than those above", "x")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert by == {(7, 3), (3, 3), (None, 3), (5, 3), (9, 8), (8, 8), (11, 11)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = {v: min(d for d, p in prints.items() if p in g) for g in groups(set(prints.values()), 3) for v in g}
    got = near_duplicates(docs).collect()
    assert {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got} == {(d, p, ids[p]) for d, p in prints.items()}
    assert np.unique([r["doc_id"] for r in got]).size == len(texts)


def test_keys_stay_exact_among_nulls(spark):
    big = 2**60 + 1
    got = near_duplicates(spark.createDataFrame([(big, "a b c"), (None, "d e f"), (big + 2, "g h i")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {big, None, big + 2}
