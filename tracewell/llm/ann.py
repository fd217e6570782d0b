"""Nearest neighbours by inner product: collision counting over single projections, with query-centred windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    projections: int = 48  # sorted arrays of a block
    threshold: float = 0.55  # part of the projections in which a vector must collide with the query to be verified
    width: float = 0.8  # half of the first window, for vectors of length 1
    margin: float = 1.0  # standard deviations by which the nearest are expected to pass the threshold
    block: int = 4096  # index rows of a block
    queries: int = 8192  # queries of a block


RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): rows whose vector has no null and no non-finite component and is not zero, as doubles."""
    v = F.col(column).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v"), F.size(v).alias("dim")).where(fine & F.exists("v", lambda x: x != 0))


def within(p: float) -> float:
    """The value that the absolute value of a standard normal variable stays below with probability p."""
    return NormalDist().inv_cdf((1 + p) / 2)


def search_block(index: np.ndarray, queries: np.ndarray, reach: float, k: int, params: Params) -> Iterator[np.ndarray]:
    """Of each query, the rows of the block that were verified: among them the nearest, with high probability.

    Inner products become distances between vectors of length 1: index vectors are divided by `reach`, their greatest length
    anywhere, and get one more component that fills them up; queries are normalised and get a 0. Each projection's values
    are sorted once; a query's window in it is all values within w of its own, a range of ranks. Rows whose ranks lie in enough of the query's
    windows collide with it and are verified. While fewer than k are, w grows; each window holds the one before it (virtual rehashing). The k-th
    verified distance then gives the last w: a row at that distance collides as often as asked, with a margin for chance.
    """
    n, dim = index.shape
    x = np.empty((n, dim + 1))
    x[:, :dim] = index / reach
    x[:, dim] = np.sqrt(np.maximum(0, 1 - (x[:, :dim] ** 2).sum(axis=1)))
    q = np.zeros((len(queries), dim + 1))
    q[:, :dim] = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    lines = np.random.default_rng(7).standard_normal((dim + 1, params.projections))
    values = (x @ lines).T
    order = np.argsort(values, axis=1, kind="stable")
    values = np.take_along_axis(values, order, axis=1)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    ranks = np.empty(order.shape, kind)
    np.put_along_axis(ranks, order, np.arange(n, dtype=kind)[None, :], axis=1)
    centres = (q @ lines).T
    p, m = params.threshold, params.projections
    asked, k = int(np.ceil(p * m)), min(k, n)
    # the projection of a difference of length d is within w with probability p at d = w / within(p)
    safe = within(min(0.99, p + params.margin * np.sqrt(p * (1 - p) / m)))

    def windows(at: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
        """Rows that collide often enough with each of the queries `at`, in windows of half-width w."""
        first = np.stack([v.searchsorted(c[at] - w, "left") for v, c in zip(values, centres, strict=True)], axis=1).astype(kind)
        stop = np.stack([v.searchsorted(c[at] + w, "right") for v, c in zip(values, centres, strict=True)], axis=1).astype(kind)
        for a, size in zip(first[:, :, None], (stop - first)[:, :, None], strict=True):
            met = ranks - a < size  # a rank below the window's first wraps around
            yield np.flatnonzero(np.add.reduce(met.view(np.uint8), axis=0, dtype=np.uint8 if m < 256 else np.int32) >= asked)

    last, left, w = np.zeros(len(q)), np.arange(len(q)), params.width
    while len(left):
        few = []
        for i, found in zip(left.tolist(), windows(left, np.full(len(left), w)), strict=True):
            if len(found) < k:
                few.append(i)
            else:
                near = 2 - 2 * np.partition(x.take(found, axis=0) @ q[i], len(found) - k)[len(found) - k]
                last[i] = max(w, safe * np.sqrt(max(near, 0)))
        left, w = np.array(few, int), 1.5 * w
    yield from windows(np.arange(len(q)), last)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (key, column), the k rows of `vectors` with the largest inner product found.

    score is the inner product of the original vectors in double precision; nearest first, ties to the smaller vec_id, and a
    query's own vec_id is passed over. All rows are indexed, dealt by hash of their key to blocks of bounded size, so that results do not depend on files, and
    every block of queries meets every block of rows, so no task holds more than two blocks; each pair of blocks
    gives up to k of a query, which are merged. Each block verifies its share of k and more, so a query has min(k, rows) results.

    Rows with a null key, or whose vector is null, empty, zero, or holds null or non-finite components take no part, neither as
    queries nor as candidates; nor does a row meet a query of another length. Repeated rows with the same key are results
    of their own. Empty tables give no rows; other columns are not used.
    """
    rows, asked = usable(vectors, key, column), usable(queries, key, column)
    n, reach = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    m = asked.count()
    blocks, query_blocks = max(1, -(-n // params.block)), max(1, -(-m // params.queries))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("b", deal(blocks)).select("id", "v", "dim", "b", every(query_blocks).alias("q"))
    right = asked.withColumn("q", deal(query_blocks)).select("id", "v", "dim", every(blocks).alias("b"), "q")

    # rows are dealt by hash, so a block rarely holds more of a query's k nearest than this
    share = (k + 1) / blocks
    own_k = min(k + 1, int(np.ceil(share + 3 * np.sqrt(share))))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for dim, own in asked.groupby("dim"):
            there = index[index["dim"] == dim]
            if not len(there):
                continue
            x, q = np.stack(there["v"].to_numpy()), np.stack(own["v"].to_numpy())
            ids = there["id"].to_numpy()
            for qid, v, found in zip(own["id"].to_numpy(), q, search_block(x, q, reach, own_k, params), strict=True):
                found = found[ids[found] != qid]
                score = x.take(found, axis=0) @ v
                if len(score) > k:  # those that may be among the nearest are scored in one fixed order of addition
                    found = found[score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * reach * np.linalg.norm(v)]
                score = (x[found] * v).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), qid), ids[found][best], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, RESULT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
