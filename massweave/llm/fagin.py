"""Exact top-k inner products by the threshold algorithm over sorted lists of each dimension.

Vectors become integers, ``floor(256 * component)``.  Rows and queries are dealt into blocks of
bounded size, and each pair of blocks is a cell, one group of a cogroup; a cell sorts its rows
once for each dimension.  A query walks down the lists from the end that its sign prefers, scores
what it meets for the first time, and stops when the sum of what the lists can still give falls
below its kth score (an equal sum could still hold a smaller id).  The best k of the cells, k a
cell at most, are merged by a window.

Defined cases: a vector that is null or has a null or non-finite component takes no part, neither
as a query nor as a row; an empty vector, and what a shorter vector lacks, counts as zero.  Rows
without an id are candidates (last among equal scores) but no queries.  Repeated rows are all
candidates (of equal rows ``k`` are kept before the blocks, since no list of k can hold more); equal query rows are asked once; rows that share the query's id are its own.  Scores
beyond 64 bits stay at their limit.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

#: Rows and queries of a block; a cell holds one block of each.
ROWS, QUERIES = 1 << 14, 1 << 12
#: First depth of the walk; it doubles from then on.
DEPTH = 64
_MOST, _LEAST = 2**63 - 1, -(2**63)


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, v) with the integers as doubles; vectors that take no part are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    sound = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < F.lit(float("inf"))))
    # Doubles hold the floor exactly; floor() itself would give longs that can't hold large ones.
    whole = lambda c: F.when(F.abs(c * 256) < 2**52, F.floor(c * 256).cast("double")).otherwise(c * 256)
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of one width (shorter ones end in zeros)."""
    out = np.zeros((len(lists), width))
    at = 0
    for c in lists.chunks:
        n = np.asarray(c.value_lengths()).astype(np.int64)
        flat = np.asarray(c.flatten())
        rows = np.repeat(np.arange(at, at + len(n)), n)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        at += len(n)
    return out


def number_kind(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest number type in which every sum of products is exact."""
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _first(k: int, keep: np.ndarray, best: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The first ``k`` of ``keep`` by score, then by row."""
    if score.dtype == object:
        return np.array(sorted(keep, key=lambda i: (-score[i], best[i]))[:k], np.int64)
    return keep[np.lexsort((best[keep], -score[keep]))][:k]


def _limited(score: np.ndarray) -> np.ndarray:
    """Scores within 64 bits (only exact large integers can be beyond)."""
    return np.array([max(_LEAST, min(_MOST, s)) for s in score], object) if score.dtype == object else score


def threshold_topk(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, depth: int = DEPTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (row of ``q``): its number, rows of ``x`` with the k best scores, the scores, and how many rows were scored.

    Ties go to the smaller id; ``own`` holds the id of each query, whose rows take no part.
    """
    kind = number_kind(x, q)
    n, d = x.shape
    order = np.argsort(ids, kind="stable")  # rows by id, so that ties are the smaller row number
    x, ids = x[order], ids[order]
    if kind is object:
        x, q = (np.array([[int(c) for c in r] for r in m], object).reshape(m.shape) for m in (x, q))
    else:
        x, q = x.astype(kind), q.astype(kind)
    lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T) if d else np.zeros((0, n), np.int64)  # ascending, one list for each dimension
    values = np.take_along_axis(x.T, lists, 1) if d else np.zeros((0, n))
    for j in range(len(q)):
        use = np.flatnonzero(q[j] != 0)
        up = np.array([c > 0 for c in q[j][use]], bool)  # large components first
        seen = np.zeros(n, bool)
        seen[np.searchsorted(ids, own[j], "left") : np.searchsorted(ids, own[j], "right")] = True
        hidden = int(seen.sum())
        best, score = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        at, to, scored = 0, min(depth, n), 0
        while True:
            if len(use) and to < n:
                fresh = np.zeros(n, bool)
                fresh[lists[use[up], n - to : n - at]] = True
                fresh[lists[use[~up], at:to]] = True
                new = np.flatnonzero(fresh & ~seen)
            else:  # at the end of the lists every row has been met
                to = n
                new = np.flatnonzero(~seen)
            seen[new] = True
            scored += len(new)
            best, score = np.concatenate([best, new]), np.concatenate([score, _limited(x[new] @ q[j] if len(new) else np.zeros(0, x.dtype))])
            if len(best) > k:
                kth = np.sort(score)[-k] if kind is object else np.partition(score, -k)[-k]
                keep = _first(k, np.flatnonzero(score >= kth), best, score)
                best, score = best[keep], score[keep]
            if to >= n or scored + hidden == n:
                break
            if len(best) == k:
                edge = np.where(up, values[use, n - to], values[use, to - 1])  # what the lists can still give
                if _limited((edge * q[j][use]).sum(keepdims=True))[0] < min(score):
                    break
            at, to = to, min(2 * to, n)
        yield j, order[best], score, scored


_HITS = "query_id long, vec_id long, score long, scored long"


def _cell(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": [], "scored": []}
        if rows.num_rows and queries.num_rows:
            width = max(int(np.asarray(c.value_lengths()).max(initial=0)) for t in (rows, queries) for c in t["v"].chunks)
            ids = np.array([_MOST if i is None else i for i in rows["id"].to_pylist()], np.int64)
            null = np.array([i is None for i in rows["id"].to_pylist()])
            own = np.asarray(queries["id"]).astype(np.int64)
            x, q = matrix(rows["v"], width), matrix(queries["v"], width)
            for j, best, score, scored in threshold_topk(x, ids, q, own, k):
                for b, s in zip(best.tolist(), score.tolist(), strict=True):
                    for name, v in (("query_id", int(own[j])), ("vec_id", None if null[b] else int(ids[b])), ("score", int(s)), ("scored", scored)):
                        out[name].append(v)
                    scored = 0  # counted once for each query and cell
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = ROWS, asked: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer inner product for each query."""
    ship(vectors.sparkSession)
    x = quantised(vectors, id_col, vec_col)
    q = materialise(quantised(queries, id_col, vec_col).where(F.col("id").isNotNull()).distinct(), "fagin_queries")
    n_rows, n_asked = max(1, -(-x.count() // rows)), max(1, -(-q.count() // asked))
    block = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.col("v"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.groupBy("id", "v").agg(F.count("*").alias("c")).select("id", "v", block(n_rows, 1).alias("b"), F.explode(F.array_repeat(F.lit(0), F.least("c", F.lit(k)).cast("int")))).drop("col").select("*", every(n_asked).alias("a"))
    right = q.select("id", "v", block(n_asked, 2).alias("a")).select("*", every(n_rows).alias("b"))
    hits = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_cell(k), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


