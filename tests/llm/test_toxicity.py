"""Toxicity: held-out accuracy, calibration, odd rows."""

import numpy as np
import pytest

from quire.llm import toxicity
from quire.llm.queries import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out())
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, sample_rows=2500)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where(held_out()), "doc_id")
    got = toxicity.flag(docs.select("doc_id", "text", "toxic"), model).toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.97
    assert (got.predicted == got.toxic).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_obfuscated_words_count(model):
    plain = "the of and to in that is was for on as with " * 5
    scores = model.score([plain, f"{plain} idiot {plain} moron scum", f"{plain} 1d1ot m.o.r.o.n sc*um {plain}"])
    assert scores[0] < 0.5 < scores[1] and scores[2] > scores[0]


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0), (3, "idiot " * 40_000, 3.0), (4, "1" * 50_000, 1.0)], "doc_id long, text string, score double")
    got = toxicity.flag(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, None)}) == 1
    assert toxicity.flag(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels, expected in (([], 0.0), ([(1, 1), (2, 1), (None, 0), (2, None)], 1.0), ([(1, 0)], 0.0)):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.flag(docs, m).collect()] == [expected] * 2


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 60):
        x = rng.normal(size=n)
        y = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(float)
        f = toxicity.Isotonic().fit(x, y)
        assert (np.diff(f(np.sort(x))) >= 0).all()
        y = y[np.argsort(x)]
        # the least squares fit: at each place the greatest of the least means of what begins before and ends after it
        best = [max(min(y[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert f.y == pytest.approx(np.unique(np.round(best, 12)))


def test_splits_gain_most_of_all():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = np.round(rng.normal(size=(80, 4)), 1)
        y = (x[:, 1] + rng.normal(size=80) > 0).astype(float)
        t = toxicity.Trees(trees=1, depth=1).fit(x, y)
        g, h = y - y.mean(), np.full(80, y.mean() * (1 - y.mean()))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.least)
        every = {}
        for j in range(4):
            for c in t.cuts[j]:
                right = x[:, j] >= c
                if min(right.sum(), (~right).sum()) >= t.leaf_rows:
                    every[j, c] = gain(right) + gain(~right)
        (splits,), leaves = t.nodes[0]
        j, k = splits[0]
        right = x[:, j] >= t.cuts[j][k - 1]
        assert gain(right) + gain(~right) == pytest.approx(max(every.values()))
        assert leaves == pytest.approx([g[m].sum() / (h[m].sum() + t.least) for m in (~right, right)])
        assert t.raw(x) == pytest.approx(t.start + t.rate * leaves[right.astype(int)])


def test_the_lexicon_holds_all_words_of_the_sample(spark):
    letters = "abcdefghijklmnop"
    name = lambda i: "".join(letters[i >> 4 * k & 15] for k in range(4))
    docs = spark.createDataFrame([(d, " ".join(name(i) for i in range(25_000)) if d < 2 else "q r s") for d in range(8)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(d, int(d < 2)) for d in range(8)], "doc_id long, toxic int"))
    assert len(model.lexicon.all) == 25_000
