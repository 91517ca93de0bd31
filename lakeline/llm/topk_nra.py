"""Exact top-k search by inner product with the no-random-access algorithm.

Candidates and queries are dealt into blocks; every pair of blocks is worked on by itself, and each query's best of all
blocks are merged. A block of candidates holds a sorted list of (value, candidate) per dimension. For a query the lists are read in order, from the end
where they add most, all to one depth, which grows step by step; no value is looked at before its list is read that far. A candidate's score has a lower bound (what was seen of
it, and the lists' worst values for the rest) and an upper bound (what was seen, and the values at the depth reached for
the rest). A candidate whose upper bound is below the k-th best lower bound is an outsider for good. A query stops reading
when no more than `FEW` times k candidates are not outsiders (or the lists end); only then are these candidates' whole vectors fetched, and
their final scores resolved, each query's for itself. Ties at a bound stay in, so that equal scores go to the smaller id. The queries of a block read side by
side, those that have stopped no longer.

All candidates meet all queries, so the work grows with the product of both numbers, and in dimensions without structure lists are read nearly
to their ends: this is meant for query sets of up to some 10^5 and for candidates of up to some 10^8.

Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors of different lengths
have no score with each other; repeated rows are candidates each; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import written

#: Rows in a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 32768
#: Steps of the depth: after each, a list's unread part is so much of the one before.
LEFT = 0.5
#: Times k candidates, not outsiders, at which a query stops reading.
FEW = 4
#: Queries whose bounds are held at one time.
AT_ONCE = 256


def depths(n: int) -> list[int]:
    """The depths that lists of n entries are read to, one after the other."""
    out, unread = [], float(n)
    while unread >= 1:
        unread *= LEFT
        out.append(n - int(unread))
    return out


class Lists:
    """For each dimension the candidates' values in ascending order, and whose they are."""

    def __init__(self, v: np.ndarray):
        order = np.argsort(v, axis=0, kind="stable")
        self.candidates, self.values = order.T, np.take_along_axis(v, order, axis=0).T
        self.n, self.dims = v.shape

    def known(self, depth: int, top: bool, rest: np.ndarray) -> np.ndarray:
        """What the lists say of all candidates when they are read to that depth from the top or from the bottom: values that were read, and rest for others."""
        part = slice(self.n - depth, self.n) if top else slice(0, depth)
        out = np.empty((self.n, self.dims), dtype=self.values.dtype)
        out[:] = rest
        out[self.candidates[:, part], np.arange(self.dims)[:, None]] = self.values[:, part]
        return out

    def bounds(self, depth: int, left: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of queries (their positive and negative parts) for the candidates left, all lists read to depth.

        Positive weights read from the top, negative ones from the bottom; what is unread is between the value at the depth and the list's end.
        """
        least, most = self.values[:, 0], self.values[:, -1]
        top, bottom = self.values[:, self.n - depth], self.values[:, depth - 1]
        upper = gain @ self.known(depth, True, top)[left].T + loss @ self.known(depth, False, bottom)[left].T
        lower = gain @ self.known(depth, True, least)[left].T + loss @ self.known(depth, False, most)[left].T
        return lower, upper


def read(lists: Lists, q: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """Reads the lists for some queries, and returns the depth that each stopped at.

    open_ (query by candidate) says which candidates are allowed, and afterwards which are not outsiders.
    """
    none = -np.inf if q.dtype.kind == "f" else np.iinfo(np.int64).min
    stopped = np.zeros(len(q), dtype=np.int64)
    busy = np.flatnonzero(open_.sum(axis=1) > FEW * k)
    for depth in depths(lists.n):
        if not len(busy):
            break
        left = np.flatnonzero(open_[busy].any(axis=0))
        lower, upper = lists.bounds(depth, left, np.maximum(q[busy], 0), np.minimum(q[busy], 0))
        own = open_[np.ix_(busy, left)]
        lower[~own] = none
        least = np.partition(lower, len(left) - k, axis=1)[:, len(left) - k]
        own &= upper >= least[:, None]
        open_[np.ix_(busy, left)] = own
        stopped[busy] = depth
        busy = busy[own.sum(axis=1) > FEW * k]
    return stopped


def block_top(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, candidate id, score) of each query's k best candidates in a block."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    exact = v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53
    v, q = (v.astype(np.float64), q.astype(np.float64)) if exact else (v, q)
    lists = Lists(v)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), AT_ONCE):
        part, own = q[at : at + AT_ONCE], query_ids[at : at + AT_ONCE]
        open_ = ids[None, :] != own[:, None]
        read(lists, part, open_, k)
        for i, weights in enumerate(part):
            fit = np.flatnonzero(open_[i])
            score = v[fit] @ weights
            best = np.argsort(-score, kind="stable")[:k]  # candidates are in order of their ids
            out[0].append(np.full(len(best), own[i]))
            out[1].append(ids[fit[best]])
            out[2].append(score[best].astype(np.int64))
    return out


def scaled(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, v, dim) of the vectors that take part; v holds floor(scale * x)."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.col(vec_col)).alias("x")).where("x is not null")
    return valid.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.size("x").alias("dim"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """queries and candidates: (vec_id, v, dim). Rows (query_id, rank, vec_id, score); a query's own id is no candidate."""
    n_q, n_c = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERIES)), max(1, -(-n_c // CANDIDATES))
    dealt = lambda df, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", dealt(queries, q_blocks).alias("qb"), all_of(c_blocks).alias("cb"), "vec_id", "v")
    right = candidates.select("dim", dealt(candidates, c_blocks).alias("cb"), all_of(q_blocks).alias("qb"), "vec_id", "v")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if q.num_rows and c.num_rows:
            dim = q["dim"][0].as_py()
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
            found = block_top(c["vec_id"].to_numpy(), matrix(c), q["vec_id"].to_numpy(), matrix(q), k)
        cols = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    best = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every vector whose id is divisible by `every` against all others."""
    rows = written(scaled(vectors, scale, id_col, vec_col), "vectors")
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)
