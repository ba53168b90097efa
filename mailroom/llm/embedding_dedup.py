"""Near-duplicates among embeddings: int8 tile products with error bounds.

``near_duplicates(vectors)`` links vectors with a cosine of ``threshold`` or more
(double precision) and returns one row for each row: vec_id, n_links (long:
other vectors linked directly), component_id (long: the smallest vec_id that
links reach, its own included) and kept (boolean: vec_id = component_id).

How it works
  1. Equal vectors are one *representative* with a number of copies (partial
     aggregate on the vector: one held by a third of all rows is one row after
     the map side).
  2. Representatives are dealt into blocks of about ``TILE`` rows; every pair of
     blocks is a task, a *tile* of the similarity matrix, and bounded.
  3. In a task each unit vector u is *quantised* to int8: u = s * q + e with
     s = max|u| / 127, and |e| is computed, not estimated. For u = s * q + e and
     w = t * p + f, |u.w - s * t * q.p| <= |s * q| * |f| + |e| * |w|, a rigorous bound
     for this very pair (with a margin for the rounding of doubles).
  4. q.p is an integer. Tiles are multiplied in single precision, in blocks of
     dimensions short enough that every partial sum stays exact (below 2^24).
  5. Only pairs whose bound reaches the threshold are *recomputed in full
     precision*, and decided by that. No pair leaves a task: it returns, for each
     member with a link, the links in this tile and a link of a spanning forest.
  6. Links add up by representative; connected components of the forests' links
     give component_id.

The tiles are a join of all pairs: its work grows with the square of the distinct
vectors, since a cosine of any two has to be bounded.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing (n_links 0, a component of their own); vectors of
different lengths do not link; repeated rows link with each other; a row with a
null vec_id links as others do but gives no component_id unless its component
has no other (then component_id is null and kept false); an empty table gives an
empty result; further columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import batched, ready, runs, salt_of, salted, stored

THRESHOLD = 0.95
TILE = 8192
_SLICE = 512  # rows of a tile that are multiplied at a time
_EXACT = 1000  # dimensions whose products of int8 add up exactly in single precision: 1000 * 127^2 < 2^24
_RECHECK = 65_536  # pairs recomputed at a time
_ROUNDING = 1e-9  # more than doubles can lose in the bounds


def usable(vector: str):
    """Whether a vector takes part: finite, not zero, nothing missing."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q: int8, s, |s * q|, |u - s * q|) of unit vectors."""
    s = np.abs(u).max(1) / 127
    q = np.clip(np.rint(u / s[:, None]), -127, 127).astype(np.int8)
    near = s[:, None] * q
    return q, s, np.sqrt((near * near).sum(1)), np.sqrt(((u - near) ** 2).sum(1))


def _product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 matrices' rows, as doubles."""
    out = 0.0
    for d in range(0, q.shape[1], _EXACT):
        out = out + (q[:, d:d + _EXACT].astype(np.float32) @ p[:, d:d + _EXACT].astype(np.float32).T).astype(np.float64)
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers (in x, in y) of the pairs at the threshold, and how many
    pairs were recomputed. With ``same``, x is y: each pair once."""
    u, w = units(x), units(y)
    (q, s, big, e), (p, t, _, f) = quantise(u), quantise(w)
    got, checked = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for lo in range(0, len(u), _SLICE):
        hi = min(lo + _SLICE, len(u))
        most = _product(q[lo:hi], p) * s[lo:hi, None] * t[None, :]
        most += big[lo:hi, None] * f[None, :] + (e[lo:hi, None] + _ROUNDING)
        a, b = np.nonzero(most >= threshold)
        a = a + lo
        if same:
            a, b = a[a < b], b[a < b]
        checked += len(a)
        for k in range(0, len(a), _RECHECK):
            i, j = a[k:k + _RECHECK], b[k:k + _RECHECK]
            ok = (u[i] * w[j]).sum(1) >= threshold
            got.append((i[ok], j[ok]))
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), checked


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _matrix(t: pa.Table, length: int) -> np.ndarray:
    v = t.column("v").combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks)
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _tiles(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for g in runs(batches, ["size", "x", "y"]):
                mine = g.column("block").to_numpy() == g.column("x")[0].as_py()
                same = g.column("x")[0].as_py() == g.column("y")[0].as_py()
                ids, copies = g.column("rep").to_numpy(), g.column("n_copies").to_numpy()
                m = _matrix(g, g.column("size")[0].as_py())
                here, there = np.nonzero(mine)[0], np.nonzero(mine if same else ~mine)[0]
                if not len(here) or not len(there):
                    continue
                a, b, _ = tile_links(m[here], m[there], threshold, same)
                a, b = here[a], there[b]
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                root = _roots(len(ids), a, b)
                for i in np.nonzero(links)[0]:
                    yield int(ids[i]), int(ids[root[i]]), int(links[i])
        yield from batched(rows(), schema)

    return run, "rep long, root long, links long"


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, vector: str = "embedding") -> DataFrame:
    """See the module's text. ``vectors``: vec_id (long) and a vector column."""
    ready(vectors.sparkSession)
    rows = vectors.select("vec_id", F.when(usable(vector), F.col(vector)).alias("v"))
    reps = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n_copies"), F.min("vec_id").alias("least"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "ed-reps")
    # blocks of one vector length: each has about ``tile`` rows
    blocks = reps.groupBy("size").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("blocks"))
    dealt = reps.join(F.broadcast(blocks), "size")  # one row for each vector length
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    keys = ["size", "x", "y"]
    run, schema = _tiles(threshold)
    found = stored(dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "block", "rep", "n_copies", "v")
                   .mapInArrow(run, schema), "ed-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    tagged = reps.select("rep", "v", "least", "n_copies").join(links, "rep", "left").join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    # a component may hold a third of all vectors
    tagged = tagged.withColumn("_salt", salt_of("rep")).join(salted(least), ["component", "_salt"]).select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    # and so may the copies of one vector
    out = rows.withColumn("_salt", salt_of("vec_id")).join(salted(tagged), ["v", "_salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
