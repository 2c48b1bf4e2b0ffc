"""The memo against the library, on whole tables and on odd texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.packing import pack
from quire.llm.token_counts import token_counts
from quire.llm.tokens import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "\n\n  x", "it's we'll I'M don't", "a_b __c__ 12 345.67 €5", "<|endoftext|> x <|startoftext|>", "İstanbul ŉ ſ ﬁ Σς", "é é", "x" * 5000, "ª²¼ Ⅷ", "  tab\t\tb  ", "日本語 text", "'s's 'S", "a b c", "\x00\x1f", "ñÑßŸÿ"]


def library(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    for t in ODD:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder(path).ids(t), dtype="<u4").tolist() == ids, t
        assert encoder(path).count(t) == len(ids)


@pytest.mark.parametrize("name", FILES)
def test_every_letter(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    for c in map(chr, range(1, 0x250)):
        t = f"x{c}Y {c} {c}{c}1'{c}2{c} 's{c}"
        assert np.frombuffer(encoder(path).ids(t), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, c


@pytest.mark.parametrize("name", FILES)
def test_any_text(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'sS\t\nÉçß_-1<|>. ", max_size=80)))
    def check(t):
        assert np.frombuffer(encoder(path).ids(t), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids

    check()


def test_counts_of_a_table(spark, tmp_path):
    path = public_tokenizers.path(FILES[0])
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for _ in range(2):  # the second time the cache has all
        got = token_counts(docs, path, f"file://{tmp_path}/cache", keep=["doc_id"]).collect()
        assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == {(d, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for d, t in texts.items()}
    assert spark.read.parquet(f"file://{tmp_path}/cache").count() == len(set(texts.values()))


def test_counts_of_odd_rows(spark, tmp_path):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", 7), (3, "word " * 30_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, path, f"file://{tmp_path}/c").collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 0, 0), (None, 3, 2), (2, 0, 0), (3, 150_000, len(library(path, "word " * 30_000)))], key=str)
    assert token_counts(docs.limit(0), path, f"file://{tmp_path}/d").count() == 0


def check_pieces(pieces, texts, path, length):
    lib = Tokenizer.from_file(path)
    whole = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(whole)
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r["start"])
        ids = [i for r in rs for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
        assert ids == whole[d] and all(r["doc_tokens"] == len(ids) for r in rs)
        assert [r["start"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs[:-1])]).tolist()
    for s, rs in by_seq.items():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs[:-1])]).tolist()
        assert sum(r["length"] for r in rs) == length or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("length", [4096, 64])
def test_packing_is_a_round_trip(spark, length):
    path = public_tokenizers.path(FILES[1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    check_pieces(pack(docs, path, length).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, path, length)


def test_packing_of_odd_rows(spark):
    path = public_tokenizers.path(FILES[1])
    rows = [(1, None, 5), (4, "", 1), (3, "word " * 30_000, 8), (None, "one two", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    check_pieces(pack(docs, path).collect(), {d: t for d, t, _ in rows}, path, 4096)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r["offset"], r["length"], zlib.crc32(r["ids"])) for r in pack(twice, path).collect())[1][0] == 3
    assert pack(docs.limit(0), path).count() == 0


def test_packing_with_clashing_names(spark):
    path = public_tokenizers.path(FILES[1])
    rows = [(i, "some words " * i, 1, "x", 2, 3, 4, "y") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, before string, at int, base int, total int, content string")
    check_pieces(pack(docs, path, 16).collect(), {r[0]: r[1] for r in rows}, path, 16)
    for name in ("part", "content", "before", "n", "ids", "sequence_id"):
        got = pack(docs.select("doc_id", "text").withColumnRenamed("doc_id", name), path, 16, key=name)
        assert got.columns.count(name) == 1 and sorted({r[name] for r in got.collect()}) == list(range(5))
