"""Approximate nearest neighbours by cross-polytope hashing.

Pseudo-rotations (random signs and fast Hadamard transforms, three times) turn unit vectors; the signed axis nearest to
a turned vector is its hash. Every distinct vector stands in each of several tables in the cell of its hash; a query
looks into the cells that are nearest to it and scores what stands there exactly. Equal vectors are one entry, with the
few smallest ids that a result can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Entries and queries of a cell that are multiplied at a time.
ROWS = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two; it keeps lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int, turn: int, seed: int) -> np.ndarray:
    """Rows of x, filled with zeros to a power of two, after the pseudo-rotation of a table."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, turn, d])
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], d))
    return out


def cells(x: np.ndarray, table: int, turns: int, probes: int, seed: int = 7) -> np.ndarray:
    """For each row its probes nearest cells of a table, nearest first. A cell is a signed axis for each of turns rotations."""
    best, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for turn in range(turns):
        y = turned(x, table, turn, seed)
        both = np.concatenate([y, -y], axis=1)
        k = min(probes, both.shape[1])
        axis = np.argsort(-both, axis=1, kind="stable")[:, :k]
        # how far the axis is from the nearest one, in angle's terms
        loss = both.max(axis=1, keepdims=True) - np.take_along_axis(both, axis, 1)
        best = (best[:, :, None] * both.shape[1] + axis[:, None, :]).reshape(len(x), -1)
        score = (score[:, :, None] + loss[:, None, :] ** 2).reshape(len(x), -1)
        keep = np.argsort(score, axis=1, kind="stable")[:, : min(probes, score.shape[1])]
        best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
    return best


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(tables: int, turns: int, probes: int, seed: int, whole: bool = True):
    """probes: 1 for entries. Without whole, cells only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby(batch["vector"].map(len)):
                x = _unit(_matrix(b["vector"]))
                for t in range(tables):
                    c = cells(x, t, turns, probes, seed)
                    if not whole:
                        yield pd.DataFrame({"dim": int(dim), "tab": t, "cell": c.reshape(-1)})
                        continue
                    k = c.shape[1]
                    rows = np.repeat(np.arange(len(b)), k)
                    yield pd.DataFrame({"dim": int(dim), "tab": t, "cell": c.reshape(-1), "id": b["id"].to_numpy()[rows], "vector": b["vector"].to_numpy()[rows]})

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision and by one rule for every pair."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(q: np.ndarray, e: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, most: int) -> pd.DataFrame:
    """For each query the most best entries, and any that tie with the last of them; ROWS of each are multiplied at a time."""
    found = []
    unit = _unit(e)
    for i in range(0, len(q), ROWS):
        part = _unit(q[i : i + ROWS])
        row, column, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(part), -np.inf)
        for j in range(0, len(e), ROWS):
            score = part @ unit[j : j + ROWS].T
            if score.shape[1] > most:
                least = np.maximum(least, -np.partition(-score, most - 1, axis=1)[:, most - 1])
            # rounding may differ between products of blocks, so near ties stay until they are scored by rule
            r, c = np.nonzero(score >= least[:, None] - 1e-12)
            row, column, near = np.concatenate([row, r]), np.concatenate([column, c + j]), np.concatenate([near, score[r, c]])
            order = np.lexsort((-near, row))
            row, column, near = row[order], column[order], near[order]
            last = np.searchsorted(row, np.arange(len(part))) + most - 1
            whole = np.flatnonzero(last < np.searchsorted(row, np.arange(len(part)), side="right"))
            least[whole] = near[last[whole]]
            keep = near >= least[row] - 1e-12
            row, column, near = row[keep], column[keep], near[keep]
        found.append(pd.DataFrame({"query": query_ids[i : i + ROWS][row], "id": ids[column], "score": cosine(q[i : i + ROWS][row], e[column])}))
    return pd.concat(found)


def _scored(most: int):
    """Rows come by table, cell and part, entries (query false) first; a part's entries are bounded, its queries stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for batch in batches:
            for key, b in batch.groupby(["dim", "tab", "cell", "part"], sort=False):
                if key != cell:
                    cell, held = key, []
                new, asked = b[~b["query"]], b[b["query"]]
                if len(new):
                    held.append((_matrix(new["vector"]), new["id"].to_numpy()))
                if len(asked) and held:
                    held = [(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                    yield _best(_matrix(asked["vector"]), held[0][0], asked["id"].to_numpy(), held[0][1], most)

    return run


def _full_cells(base: DataFrame, tables: int, turns: int, part_rows: int, seed: int) -> DataFrame:
    """(dim, tab, cell, parts) of the cells with more than part_rows entries: at most tables * rows / part_rows of them."""
    stand = base.mapInPandas(_entries(tables, turns, 1, seed, False), "dim int, tab int, cell long")
    return stand.groupBy("dim", "tab", "cell").count().where(F.col("count") > part_rows).select("dim", "tab", "cell", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))


def nearest(vectors: DataFrame, queries, k: int = 5, tables: int = 4, turns: int = 1, probes: int = 40, part_rows: int = 20_000, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row that the condition queries chooses.

    Nearness is the cosine in double precision; ties go to the smaller id; a row is not its own neighbour. Null vectors,
    zero ones and those with null or non-finite components take no part, nor do null ids; vectors meet only those of
    their length. Rows with one id and different vectors are rows of their own; of equal rows one counts. An
    empty table gives an empty one.

    turns: rotations that make a cell. One gives twice as many cells as a vector has components, and a recall that does
    not fall as rows are added; two suit vectors with near neighbours, with probes to match. Each cell's entries are counted and
    dealt to parts of about part_rows by their ids, to each of which its queries go.
    """
    spark = vectors.sparkSession
    shared.prepare(spark)
    kind = "float" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "double"
    v = F.transform(F.col(vector), lambda x: x.cast(kind))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    # adding zero makes one of the two zeros; two 64-bit digests tell vectors apart
    plain = F.transform(v, lambda x: x + F.lit(0.0).cast(kind))
    rows = rows.select(F.col(key).cast("long").alias("id"), plain.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit("second"), "v")}).distinct()
    # the ids that a result can need of equal vectors: the k smallest and one for the query itself
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min_by("v", "n").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))
    classes = shared.save(classes, "vector-classes")
    asking = shared.save(rows.where("asks").select(F.col("id").alias("query_id"), "d1", "d2").join(classes.select("d1", "d2", F.col("id").alias("query")), ["d1", "d2"]).select("query_id", "query"), "vector-queries")
    base = classes.select("id", F.col("v").alias("vector"))
    asked = base.join(asking.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    schema = f"dim int, tab int, cell long, id long, vector array<{kind}>"
    full = shared.save(_full_cells(base, tables, turns, part_rows, seed), "vector-cells")
    parts = F.coalesce("parts", F.lit(1))
    stand = base.mapInPandas(_entries(tables, turns, 1, seed), schema).join(full, ["dim", "tab", "cell"], "left")
    stand = stand.withColumns({"query": F.lit(False), "part": F.pmod(F.xxhash64("id"), parts).cast("int")}).drop("parts")
    look = asked.mapInPandas(_entries(tables, turns, probes, seed), schema).join(full, ["dim", "tab", "cell"], "left")
    look = look.withColumns({"query": F.lit(True), "part": F.explode(F.sequence(F.lit(0), parts - 1))}).drop("parts")
    both = stand.unionByName(look).repartition("dim", "tab", "cell", "part").sortWithinPartitions("dim", "tab", "cell", "part", "query")
    # a query's own class is one of them
    scored = both.mapInPandas(_scored(k + 1), "query long, id long, score double").distinct()
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    named = best.select("query", "id", "score").join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    out = asking.join(named, "query").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
