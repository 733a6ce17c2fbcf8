"""Nearest neighbours of stated queries: a block matrix join with int8 tiles, error bounds and heaps.

Vectors are rounded to int8 with a scale of their own; the length of what rounding takes away bounds the error. Rows go
to groups by a hash: candidates to C groups, queries to R groups, and every pair of groups is one tile, read by one
task. In a tile, int8 products give distances; with the error bounds they give a least and a most for each pair. A pair
survives if its least is no more than the k-th smallest most of its query. Survivors are computed again from the
original vectors in double precision and go to the query's heap of k; the heaps of all tiles are merged by query. As
bounds are sure, results are those of brute force.

Equal vectors of a tile are compared once; of their ids the k + 1 smallest are kept, as no more can be among k nearest.

Vectors that are null, zero or hold null or non-finite components, and null ids, take no part; vectors of different
lengths are never compared. Groups are sized by the bytes of their vectors, so long ones are in smaller groups; texts
take no part. Columns of the input other than the two named are left out, so none can clash. Pairs whose bounds are
beyond double precision are computed exactly. Rows equal in id and vector count once; a query's own id is never its candidate; rows of
one id but different vectors are queries of their own. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that a group holds on average: SMALL while there are at most GROUPS groups, then more, up to SIDE_BYTES of vectors. Queries of a group hold as much.
SMALL, GROUPS, SIDE_BYTES = 1_024, 64, 16 << 20
#: Rows and columns of what is held of a tile at a time.
TILE = 512, 4_096


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, and bounds of the lengths of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # all components too small to divide
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    with np.errstate(over="ignore"):  # an error bound beyond all numbers excludes nothing
        error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-6) + 1e-12 * scale


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed from the first component to the last; differences whose squares are no numbers, or vanish, are scaled first."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", under="ignore"):
        for j in range(x.shape[1]):
            d = x[:, j] - y[:, j]
            total += d * d
        out = np.sqrt(total)
        odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-280))
        if len(odd):
            half = x[odd] / 2 - y[odd] / 2
            most = np.abs(half).max(axis=1, keepdims=True)
            share = np.divide(half, most, out=np.zeros_like(half), where=most > 0)
            out[odd] = 2 * (most[:, 0] * np.sqrt((share * share).sum(axis=1)))
    return out


def smallest(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (score, id) of each query, in that order."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[rank < k]


def tile(q_ids: np.ndarray, q_vectors: np.ndarray, c_ids: np.ndarray, c_vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of each query's k nearest candidates of other ids."""
    # Equal vectors once, each with its k + 1 smallest ids.
    rows = np.ascontiguousarray(c_vectors).view(np.dtype((np.void, c_vectors.shape[1] * 8))).ravel()
    _, first, which = np.unique(rows, return_index=True, return_inverse=True)
    unique = c_vectors[first]
    # An id stands once under a vector.
    pairs = np.unique(np.stack((which.ravel(), c_ids), axis=1), axis=0)
    begin = np.searchsorted(pairs[:, 0], np.arange(len(unique)))
    place = np.arange(len(pairs)) - begin[pairs[:, 0]]
    pairs = pairs[place <= k]
    begin = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
    held = np.diff(begin)

    dim = c_vectors.shape[1]
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products are whole numbers that this holds
    cq, cs, ce = quantised(unique)
    qq, qs, qe = quantised(q_vectors)
    with np.errstate(over="ignore", under="ignore"):
        cn, qn = (cs * cs) * np.einsum("ij,ij->i", cq.astype(np.float64), cq.astype(np.float64)), (qs * qs) * np.einsum("ij,ij->i", qq.astype(np.float64), qq.astype(np.float64))
    out = []
    for a in range(0, len(q_ids), TILE[0]):
        left = qq[a : a + TILE[0]].astype(exact)
        n = len(left)
        heap = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        kth = np.full(n, np.inf)
        for b in range(0, len(unique), TILE[1]):
            dot = (left @ cq[b : b + TILE[1]].astype(exact).T).astype(np.float64)
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                square = qn[a : a + n, None] + cn[None, b : b + TILE[1]]
                near = np.sqrt(np.maximum(square - 2 * dot * qs[a : a + n, None] * cs[None, b : b + TILE[1]], 0) + 0.0)
                slack = qe[a : a + n, None] + ce[None, b : b + TILE[1]] + 1e-7 * np.sqrt(square)
                width = near.shape[1]
                most = near + slack
                bound = kth
                if width > k:  # k + 1 vectors, as one may be the query's own
                    bound = np.fmin(bound, np.partition(most, k, axis=1)[:, k])
                # Pairs whose bounds are no numbers survive.
                i, j = np.nonzero(~(near - slack > bound[:, None]))
            if not len(i):
                continue
            score = distances(q_vectors[a + i], unique[b + j])
            count = held[b + j]
            at = np.repeat(begin[b + j] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            ids = pairs[at, 1]
            i, score = np.repeat(i, count), np.repeat(score, count)
            other = ids != q_ids[a + i]
            heap = tuple(np.concatenate((x, y)) for x, y in zip(heap, (i[other], ids[other], score[other])))
            keep = smallest(heap[0], heap[2], heap[1], k)
            heap = tuple(x[keep] for x in heap)
            size = np.bincount(heap[0], minlength=n)
            last = np.cumsum(size) - 1
            full = size >= k
            kth[full] = heap[2][last[full]]
        out.append((heap[0] + a, heap[1], heap[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def nearest(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row for which `queries` holds, by Euclidean distance."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")).withColumn("mark", F.xxhash64("v"))
    # Rows equal in id and vector count once; a vector asks if any of them does.
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"), F.first("dim").alias("dim"), F.first("mark").alias("mark"))
    n, held, asked = rows.agg(F.count("*"), F.sum(F.col("dim") * 8), F.sum(F.when(F.col("asks"), F.col("dim") * 8))).first()
    groups = max(1, min(GROUPS, -(-n // SMALL)), -(-int(held or 0) // SIDE_BYTES))
    blocks = max(1, -(-int(asked or 0) // SIDE_BYTES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select("id", "v", "dim", F.pmod(F.xxhash64(F.lit(1), "id", "mark"), F.lit(groups)).cast("int").alias("c"), every(blocks).alias("r"))
    asking = rows.where("asks").select("id", "v", "dim", "mark", F.pmod(F.xxhash64(F.lit(2), "id", "mark"), F.lit(blocks)).cast("int").alias("r"), every(groups).alias("c"))

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "mark", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        ids, marks = (left.column(c).to_numpy() for c in ("id", "mark"))
        _, one = np.unique(np.stack((ids, marks), axis=1), axis=0, return_index=True)
        i, vec, score = tile(ids[one], _vectors(left)[one], right.column("id").to_numpy(), _vectors(right), k)
        return pa.table([pa.array(ids[one][i]), pa.array(marks[one][i]), pa.array(vec), pa.array(score)], names=names)

    keys = ["r", "c", "dim"]
    found = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, "query_id bigint, mark bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def digest(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`."""
    return nearest(df, F.col("vec_id") % every == 0, k)
