"""Nearest neighbours where one cell holds much: it is split by its own count, and products are made in blocks."""

import tracemalloc

import numpy as np

from quire.llm import ann


def test_products_are_bounded():
    rng = np.random.default_rng(8)
    q, e = rng.normal(size=(4096, 8)), rng.normal(size=(20_000, 8))
    tracemalloc.start()
    got = ann._best(q, e, np.arange(len(q)), np.arange(len(e)), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one product of all entries is 655 MB
    assert peak < 640_000_000
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    for i in range(0, len(q), 500):
        best = got[got["query"] == i].sort_values("score", ascending=False)["id"].head(6)
        assert best.tolist() == np.argsort(-(u @ q[i]), kind="stable")[:6].tolist()


def test_a_hot_cell_is_split(spark):
    rng = np.random.default_rng(9)
    hot = np.eye(1, 16)[0] + 0.01 * rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([hot, rng.normal(size=(600, 16))]))]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    full = ann._full_cells(df, 4, 1, 50, 7).collect()
    assert max(r["parts"] for r in full) >= 3
    named = df.withColumnsRenamed({"id": "vec_id", "vector": "embedding"})
    found = [sorted(map(tuple, ann.nearest(named, named["vec_id"] % 50 == 0, part_rows=p).collect())) for p in (50, 20_000)]
    assert found[0] == found[1] and len(found[0]) == 18 * 5
