"""Spelling variants against plain Python over all pairs."""

import collections
import random
import re
import zlib

import pytest

from quire.llm.variants import near_words, variants, word_counts

SF = "/root/testdata/sf0.001"
LOWER = {65 + i: 97 + i for i in range(26)}


def plain_counts(docs, slip=31):
    out = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                out[word] += 1
    return {k: n for k, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_whole_table(spark):
    from quire.llm.queries import op11_spelling_variants

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = plain_counts(docs)
    # all pairs would be slow here: candidates share what is left without one letter
    some = dict(sorted(n.items())[:2500])
    df = spark.createDataFrame(list(some.items()), "word string, n long")
    assert got(variants(df)) == plain_variants(some)
    assert {(r.word, r.n) for r in op11_spelling_variants(spark, SF).collect()} == set(n.items())


@pytest.mark.parametrize("dense", [1, 3, 100])
def test_few_letters_fill_every_key(spark, dense):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([7, 8]))) for _ in range(220)})
    n = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = {frozenset((r.wordx, r.wordy)) for r in near_words(df, dense).collect()}
    assert pairs == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert got(variants(df, dense=dense)) == plain_variants(n)


def test_edits_at_all_places_and_odd_letters(spark):
    word = "straßeœ中\U0001f600end"
    near = {word}
    for i in range(len(word) + 1):
        near |= {word[:i] + "z" + word[i:], word[:i] + word[i + 1 :], word[:i] + "丮" + word[i + 1 :]}
    n = {w: 2 for w in near} | {word: 40}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(variants(df, dense=2)) == plain_variants(n)


def test_chains_and_ties(spark):
    n = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000, "bbcdefgh": 20, "zzzzzzz": 5, "zzzzzzy": 49}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    out = {r.word: r for r in variants(df).collect()}
    assert got(variants(df)) == plain_variants(n)
    assert out["abcdefgh"].root == "abcdefghijk" and out["abcdefgh"].form == "abcdefghi"
    assert out["zzzzzzz"].form is None and out["zzzzzzz"].n_near == 1


def test_odd_documents(spark):
    long = "Wunderbar " * 30_000
    docs = [(1, None), (2, ""), (3, "ABCDEFG abcdefg ÀBCDEFG àbcdefg"), (3, "ABCDEFG abcdefg ÀBCDEFG àbcdefg"), (None, "abcdefg nulled nullkey nullkey"), (4, long), (5, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y " * 2 + "x" * 4999 + "y"), (6, "six-sixsix")]
    df = spark.createDataFrame([(k, t, "q", 1) for k, t in docs], "doc_id long, text string, word string, n int")
    counts = word_counts(df, slip=31)
    expected = plain_counts(docs)
    assert {(r.word, r.n) for r in counts.collect()} == set(expected.items())
    assert got(variants(counts)) == plain_variants(expected)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants(word_counts(empty)).collect() == []
    odd = spark.createDataFrame([(None, 3), ("abcdefg", None), ("abcdefg", 2), ("abcdefg", 2), ("abcdefh", 40)], "word string, n long")
    assert got(variants(odd)) == plain_variants({"abcdefg": 4, "abcdefh": 40})
