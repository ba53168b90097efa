"""Exact top-k search by inner product: columnar branch and bound.

``search(vectors, queries, k)`` returns every query's ``k`` rows with the
highest integer inner product (all, if there are fewer): query_id, rank (from
1), vec_id, score (long); ties go to the smaller vec_id. Components x are read
as floor(1024 * x), x as double.

How it works
  1. Vectors fall by row into groups of about ``GROUP`` rows, queries into groups
     of ``QUERIES``; every pair of a vector group and a query group is a task of
     its own, of bounded size (the stated query set against all rows, in blocks).
  2. In a task the vectors lie in *vertical layout*: one array for each
     dimension, dimensions in order of falling mass over the group, so the first
     blocks say most. Scores accumulate dimension block by dimension block.
  3. After each block, what is still missing of a candidate's score is at most
     |rest of query| * |rest of vector| (Cauchy-Schwarz on the *remaining mass*,
     kept as suffix norms). The k-th best lower bound of a query is a floor under
     its result; candidates whose upper bound is below the floor of every query
     of the slice are dropped, and the columns of the survivors are *compacted*.
     Integers below 2^53 are exact in doubles; larger sums use 64-bit integers.
  4. A task starts with a floor from exact scores of its first rows, and carries
     it through its blocks of rows. Each task returns k rows a query at most; a
     window over these takes the k best.

Defined cases: vectors that are null or empty, or hold a null or non-finite component,
take no part, as queries or candidates, and neither do rows with a null vec_id; vectors of other lengths than a query's are
not compared with it; a query's own row (any row with its vec_id) is no
candidate; a repeated row is a candidate each time, and a repeated query (same
vec_id and vector) is answered once; scores beyond 64 bits raise OverflowError;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import ready, stored

SCALE = 1024
GROUP = 16_384
QUERIES = 1_024
DIMS = 8
_ROWS = 4_096
_SLICE = 64
_OUT = "query_id long, query_key long, vec_id long, score long"


def quantised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): array<long>, of the rows that take part."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole).select("vec_id", x.alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding") -> DataFrame:
    """See the module's text. Both tables: vec_id (long) and a vector column."""
    ready(vectors.sparkSession)
    row = F.monotonically_increasing_id()
    v = quantised(vectors, vector)
    q = stored(quantised(queries, vector).distinct().withColumn("query_key", F.xxhash64("v")), "tk-queries")
    n_rows, n_queries = v.count(), q.count()
    groups, lots = max(1, -(-n_rows // GROUP)), max(1, -(-n_queries // QUERIES))
    # rows are dealt by their number in the scan, so one repeated row cannot fill a group
    left = v.withColumn("g", F.pmod(F.xxhash64(row), F.lit(groups)).cast("int")).withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    right = q.withColumn("lot", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(lots)).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = left.groupBy("g", "lot").cogroup(right.groupBy("g", "lot"))
    found = both.applyInArrow(_task(k), _OUT)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            for dim, (ids, x) in _by_length(left).items():
                same = _by_length(right).get(dim)
                if same is None:
                    continue
                rows, y = same
                keys = right.column("query_key").to_numpy()[rows]
                names = right.column("vec_id").to_numpy()[rows]
                who, what, score = top_k(left.column("vec_id").to_numpy()[ids], x, names, y, k)
                out.append((names[who], keys[who], what, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    v = t.column("v").combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks)
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy()
    start = v.offsets.to_numpy()[:-1] - v.offsets.to_numpy()[0]
    out = {}
    for d in np.unique(size):
        rows = np.nonzero(size == d)[0]
        out[int(d)] = rows, flat[start[rows][:, None] + np.arange(d)]
    return out


def top_k(ids: np.ndarray, x: np.ndarray, names: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, vec_id, score): the k best candidates of each query
    among the rows (ids, x), without the query's own."""
    bound = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
    if bound >= 2.0 ** 63:
        raise OverflowError("inner products exceed 64 bits")
    kind = np.float64 if bound < 2.0 ** 53 else np.int64
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    x, y = x[:, order], y[:, order]
    found_i, found_s = [np.zeros(0, np.int64)] * len(y), [np.zeros(0, np.int64)] * len(y)
    # candidates in order of falling norm: high floors come early
    far = np.argsort(-(x.astype(np.float64) ** 2).sum(1), kind="stable")
    ids, x = ids[far], x[far]
    for r in range(0, len(ids), _ROWS):
        part = np.ascontiguousarray(x[r:r + _ROWS].T).astype(kind)  # vertical: one line for each dimension
        who = ids[r:r + _ROWS]
        rest = np.sqrt(np.cumsum((part.astype(np.float64) ** 2)[::-1], 0)[::-1])  # mass of dimensions d and later
        for s in range(0, len(y), _SLICE):
            lot = y[s:s + _SLICE].astype(kind)
            floor = np.array([f[k - 1] if len(f) >= k else -np.inf for f in found_s[s:s + _SLICE]])
            alive, score = _survivors(part, rest, lot, names[s:s + _SLICE], who, floor, k)
            for j in range(len(lot)):
                i = np.concatenate([found_i[s + j], who[alive][keep := _allowed(who[alive], names[s + j], score[j], floor[j])]])
                c = np.concatenate([found_s[s + j], score[j][keep].astype(np.int64)])
                best = np.lexsort((i, -c))[:k]
                found_i[s + j], found_s[s + j] = i[best], c[best]
    who = np.repeat(np.arange(len(y)), [len(f) for f in found_i])
    return who, np.concatenate(found_i), np.concatenate(found_s)


def _allowed(who: np.ndarray, name: int, score: np.ndarray, floor: float) -> np.ndarray:
    return np.nonzero((who != name) & (score >= floor))[0]


def _survivors(part: np.ndarray, rest: np.ndarray, lot: np.ndarray, names: np.ndarray, who: np.ndarray, floor: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that may still be among some query's k best, with whole scores."""
    dims = len(part)
    q_rest = np.sqrt(np.cumsum((lot.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1])
    alive = np.arange(part.shape[1])
    score = np.zeros((len(lot), len(alive)), part.dtype)
    for d in range(0, dims, DIMS):
        score += lot[:, d:d + DIMS] @ part[d:d + DIMS]
        if d + DIMS >= dims or len(alive) == 0:
            break
        # remaining mass; one more than rounding can cost
        slack = q_rest[:, d + DIMS, None] * rest[d + DIMS][alive][None, :] * (1 + 1e-9) + 1
        low = np.where(who[alive][None, :] == names[:, None], -np.inf, score - slack)
        if low.shape[1] > k:
            floor = np.maximum(floor, np.partition(low, -k, 1)[:, -k])
        stay = ((score + slack) >= floor[:, None]).any(0)
        if stay.mean() < 0.75:  # compact
            alive, score, part = alive[stay], score[:, stay], part[:, stay]
    return alive, score
