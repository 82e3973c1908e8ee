"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors apart from one another (of the 4 * ``PIVOTS`` smallest hashes of vec_id, a
bounded sample) are pivots.  A vector is represented by its ``PREFIX`` nearest pivots in order,
and posted with its place in that order in the inverted file of each of them.  Index blocks hold
the files of the vectors of a hash of vec_id.  A query reads the files of its own nearest pivots
alone: a posting there brings its vector nearer by PREFIX - |place in the query - place in the
vector|, so that what is summed orders vectors by footrule distance, a pivot missing on either
side counting as PREFIX places away; vectors that share no pivot are never touched.  The nearest
``SHARE`` of a block and ``MORE`` besides, with all that tie with the last of them, are ranked
again by exact cosine.  All vectors are indexed; blocks of queries meet blocks of vectors, and
each such pair returns only its best few.  A group of copies, however large, is spread by its
hash; within a block its equal vectors are one candidate, which stands for their smallest
vec_ids.

A vector travels once for each block of queries and a query once for each block of vectors, so
blocks are as large as a task's memory allows.  Work grows with queries times vectors.

Defined results: rows whose vec_id or vector is null, whose vector is all zero, holds a null or
a non-finite component, or differs in size from the pivots take no part; ties in score go
to the smaller vec_id; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

PIVOTS, PREFIX, SHARE, MORE = 512, 128, 0.08, 64
#: Cosine from which two sampled vectors are too alike to be pivots both.
APART = 0.9
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Bytes of the vectors of a block; wider vectors come in smaller blocks.
BLOCK_BYTES = 16 << 20


def usable(vectors: DataFrame) -> DataFrame:
    found = columns(vectors, vec_id="long", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return found.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r["embedding"]) for r in rows]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    sample = unit(np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in rows if len(r["embedding"]) == size))))
    # Pivots apart from one another first: a large group of near copies would otherwise fill the order with one place.
    chosen: list[int] = []
    for i, x in enumerate(sample):
        if len(chosen) < pivots and (not chosen or (sample[chosen] @ x).max() < APART):
            chosen.append(i)
    rest = [i for i in range(len(sample)) if i not in set(chosen)]
    return sample[sorted(chosen + rest[: pivots - len(chosen)])]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, in order."""
    parts = [np.argsort(-(x[lo : lo + 1024] @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32) for lo in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.zeros((0, prefix), np.int32)


class Files:
    """Inverted files of a block: for each pivot, the rows that have it among their nearest, and its place there."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.size, self.prefix = order.shape
        by_pivot = np.argsort(order, axis=None, kind="stable")
        self.rows = (by_pivot // self.prefix).astype(np.int32)
        self.places = (by_pivot % self.prefix).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=pivots))])

    def nearness(self, wanted: np.ndarray) -> np.ndarray:
        """Sum over shared pivots of prefix - |difference of places|, by row; 0 where none is shared."""
        out = np.zeros(self.size, np.int32)
        for place, pivot in enumerate(wanted.tolist()):
            lo, hi = self.starts[pivot], self.starts[pivot + 1]
            out[self.rows[lo:hi]] += self.prefix - np.abs(self.places[lo:hi] - place)  # a row stands once in a file
        return out


def copies(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[list[int]]]:
    """First row of each group of equal rows of x, and the group's ``most`` smallest ids (ids ascend)."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    fresh = np.append(True, (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0))  # repeated rows count once
    order = order[fresh]
    starts = np.searchsorted(group[order], np.arange(len(first) + 1))
    return first, [ids[order[lo : min(lo + most, hi)]].tolist() for lo, hi in zip(starts[:-1], starts[1:], strict=True)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, but itself."""
    vectors, queries = usable(vectors), usable(queries)
    pivots = choose_pivots(vectors)
    prefix = min(PREFIX, len(pivots))
    dims = pivots.shape[1] if len(pivots) else -1
    vectors, queries = (df.where(F.size("embedding") == dims) for df in (vectors, queries))
    many, asked = vectors.count(), queries.count()
    most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    v_blocks, q_blocks = -(-many // min(VECTOR_BLOCK, most)) or 1, -(-asked // min(QUERY_BLOCK, most)) or 1
    v_block, q_block = (F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {n}) as int)") for seed, n in ((1, v_blocks), (2, q_blocks)))
    held = vectors.withColumn("v", v_block).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    sought = queries.withColumn("q", q_block).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(block) or not len(asked):
            return empty
        # Sorted by vec_id, so the first row of equal vectors has the smallest.
        block = block.sort_values("vec_id", kind="stable")
        ids = block["vec_id"].to_numpy(np.int64)
        x, wanted = unit(np.stack(block["embedding"])) + 0.0, unit(np.stack(asked["embedding"]))  # + 0.0: no negative zeros
        first, members = copies(x, ids, k + 1)
        x, lone = x[first], np.array([m[0] if len(m) == 1 else None for m in members], object)
        keep = int(np.ceil(share * len(x))) + MORE
        files = Files(nearest_pivots(x, pivots, prefix), len(pivots))
        of, found, cosines = [], [], []
        for query_id, y, order in zip(asked["vec_id"].to_numpy(np.int64), wanted, nearest_pivots(wanted, pivots, prefix), strict=True):
            nearness = files.nearness(order)
            near = np.flatnonzero(nearness)
            if len(near) > keep:
                near = near[nearness[near] >= np.partition(nearness[near], len(near) - keep)[len(near) - keep]]
            near = near[lone[near] != query_id]
            score = x[near] @ y
            if len(near) > k:  # every candidate left has a member to return, so none below the k-th can be among the best
                near = near[score >= np.partition(score, len(near) - k)[len(near) - k] - 1e-9]
            # The few best once more, each by the same order of operations wherever its block is.
            best = sorted({(-float(np.dot(x[i], y)), vec_id) for i in near for vec_id in members[i] if vec_id != query_id})[:k]
            of += [query_id] * len(best)
            found += [v for _, v in best]
            cosines += [-c for c, _ in best]
        return pd.DataFrame({"query_id": np.array(of, np.int64), "vec_id": np.array(found, np.int64), "score": np.clip(np.array(cosines, np.float64), -1.0, 1.0)})

    found = held.groupBy("v", "q").cogroup(sought.groupBy("v", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
