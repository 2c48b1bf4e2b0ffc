"""Whitening of vectors by a covariance in two passes.

Entries become whole numbers, so the first pass's sums are exact. The second adds up outer products of centred vectors,
by matrix products within a partition and a tree over the partitions' sums. The eigenvectors of that one matrix, as wide
as a vector is long, are found by LAPACK and broadcast; a third pass measures what the projection gives, a fourth returns it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Vectors that are multiplied at a time.
ROWS = 4096


def sound(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite entries."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _blocks(column: pd.Series) -> Iterator[np.ndarray]:
    values = column.to_numpy()
    for i in range(0, len(values), ROWS):
        yield np.stack(values[i : i + ROWS])


def _products(make, width: int):
    """One sum of outer products of make's rows for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            for x in _blocks(batch["x"]):
                y = make(x)
                total += y.T @ y
        yield pd.DataFrame({"s": [total.tobytes()]})

    return run


def _added(x: DataFrame, make, width: int) -> np.ndarray:
    # a partition's sum is one row; the tree adds them on the executors, so that few reach the driver
    sums = x.mapInPandas(_products(make, width), "s binary").rdd.map(lambda r: np.frombuffer(r.s).reshape(width, width))
    return sums.treeAggregate(np.zeros((width, width)), np.add, np.add, depth=3)


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, whose largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    at = np.abs(u).argmax(axis=0)
    return e, u * np.where(u[at, np.arange(len(e))] < 0, -1.0, 1.0)


def _centred(n: int, s: np.ndarray):
    # sums of Python's numbers say that n * x may leave 64 bits
    return lambda x: ((x.astype(s.dtype) * n - s) / n).astype(float)


def _exact(n: int, s: np.ndarray, x: np.ndarray) -> list[int]:
    """Sums of (n * x - s) ** 2, in Python's numbers where 64 bits might not hold them."""
    d = x.astype(s.dtype) * n - s
    if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def _whitened(n: int, s: np.ndarray, shared_w):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared_w.value
        for batch in batches:
            for i, x in enumerate(_blocks(batch["x"])):
                part = batch["id"].iloc[i * ROWS : (i + 1) * ROWS]
                yield pd.DataFrame({"id": part, "deviation": [str(v) for v in _exact(n, s, x)], "w": list(_centred(n, s)(x) @ w)})

    return run


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each sound vector and each of the first components.

    An entry c becomes x = floor(scale * c) + offset. The fit list is all sound vectors: n of them, per-dimension sums S.
    Components are numbered from 1 by falling eigenvalue e of x's covariance (divisor n). deviation (a decimal, null beyond 38 digits) is the sum
    over dimensions of (n * x - S) ** 2; whitened is x - S / n projected on the component over sqrt(e); explained is e
    over the trace; identity_error is the largest entry of the whitened vectors' covariance minus the identity, as a pass
    over them measures it.

    Null vectors, empty ones and those with null or non-finite entries are no rows. Of vectors of several lengths those of
    the most frequent one (ties: the longest) take part. Repeated rows, null and repeated keys are rows of their own. A
    component without variance (all vectors alike in it; up to rounding: D * 2^-52 of the largest) has whitened null
    and does not count for identity_error, null where none counts; explained is null where the trace is 0. Entries
    beyond 2^61 / scale are taken as that. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    shared.prepare(spark)
    kind = vectors.schema[key].dataType
    v = F.col(vector).cast("array<double>")
    bound = float(2**61)
    rows = vectors.where(sound(v)).select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(bound)), F.lit(-bound))) + offset).alias("x"))
    # lengths are few or else any of them is rare; the most frequent is one row
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return _named(spark.createDataFrame([], "id string, deviation string, w array<double>"), key, kind, 0, [], None)
    d, n = lengths[0].d, lengths[0].n
    rows = rows.where(F.size("x") == d)
    # exact sums of each dimension, of whole numbers that a long might not hold all of
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.max(F.abs("v")).alias("most")).orderBy("i").collect()
    s = np.array([int(r.s) for r in sums], dtype=np.int64 if n * max(r.most for r in sums) < 2**61 else object)
    only_x = rows.select("x")
    v = _added(only_x, _centred(n, s), d) / n
    e, u = components(v)
    k = min(most, d)
    defined = e[:k] > max(float(e[0]), 0.0) * d * np.finfo(float).eps
    w = np.where(defined, u[:, :k] / np.sqrt(np.where(defined, e[:k], 1.0)), 0.0)
    sent = spark.sparkContext.broadcast(w)
    error = None
    if defined.any():
        c = _added(only_x, lambda x: _centred(n, s)(x) @ sent.value, k) / n - np.eye(k)
        error = float(np.abs(c[np.ix_(defined, defined)]).max())
    trace = float(np.trace(v))
    told = [(bool(defined[i]), float(e[i]) / trace if trace > 0 else None) for i in range(k)]
    out = rows.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(_whitened(n, s, sent), "id string, deviation string, w array<double>")
    return _named(out, key, kind, n, told, error)


def _named(out: DataFrame, key: str, kind, n: int, told: list, error: float | None) -> DataFrame:
    none = F.lit(None).cast("double")
    either = [F.struct(F.lit(i + 1).alias("component"), (F.col("w")[i] if fine else none).alias("whitened"), F.lit(share).cast("double").alias("explained")) for i, (fine, share) in enumerate(told)]
    empty = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    out = out.select("id", "deviation", F.explode(F.array(*either) if either else empty).alias("c"))
    found = {"component": F.col("c.component"), "n": F.lit(n).cast("long"), "deviation": F.col("deviation").try_cast("decimal(38,0)"), "whitened": F.col("c.whitened"), "explained": F.col("c.explained"), "identity_error": F.lit(error).cast("double")}
    return out.select(F.col("id").cast(kind).alias(key), *[x.alias(c) for c, x in found.items() if c != key])
