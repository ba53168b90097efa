"""N-gram Jaccard self-join over a MinHash LSH forest.

``jaccard_join(docs)`` links documents whose sets of five-word shingles have a
Jaccard similarity of at least 0.8, and returns one row for each document row:

=============  ==================================================================
doc_id         as given
class_id       smallest doc_id of the documents that links connect it to, itself
               included (null doc_ids never are a class_id, unless it has no other)
n_links        long: other rows linked to it, copies included
n_copies       long: rows with the very same shingle set, itself included
=============  ==================================================================

How it works
  1. Documents with equal shingle sets are one *representative* (partial
     aggregate on a 128-bit digest of the set, so a copied text held by a third
     of all rows is one row after the map side).
  2. *Forest.* Each representative has ``trees`` MinHash labels of ``depth``
     values. ``prefix_length`` works out, from the whole label downward, the one
     length of prefix, the same in all trees, at which a pair at the threshold
     meets in some tree with the target recall (1 - 1e-7 by default). This is
     banding: no trie is built, and no prefix is shortened by what it holds. Prefixes of one member only are dropped by a
     count on their 8-byte keys, before any signature moves.
  3. Inside the task all signatures of a prefix are compared with each other
     in blocks; what leaves is at most one *link to join* per member, never the
     pairs. A prefix with more than ``block`` members is cut into blocks, and
     each pair of blocks is a group of its own: no group exceeds 2 x block rows.
  4. Connected components of those links are the candidate groups (supersets:
     signatures must agree on 0.2 less than the threshold, over five standard
     deviations). Within one, *exact* shingle sets are compared block against
     block as matrix products; each task returns its members' link counts and a
     spanning forest of the verified links. Pairs are counted, not emitted.
  5. Components of the verified links give class_id.

Defined cases: null and empty texts have no shingles and no links; texts of 1 to
4 words have one shingle of all their words; repeated rows are copies of each
other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .util import batched, ready, runs, salt_of, salted, stored

THRESHOLD = 0.8
TREES = 32
DEPTH = 5
RECALL = 1 - 1e-7
BLOCK = 2048
# Signatures have to agree on (threshold - SLACK) of their places to be candidates.
SLACK = 0.2
_SEED = 20240229


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Shorten the matched prefix from the whole label until a pair at the
    threshold meets in at least one tree with the wanted probability."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees cannot reach recall {recall} at {threshold}")


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (rng.integers(1, 2 ** 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2 ** 63, n, dtype=np.uint64))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (uint32) of a non-empty shingle set."""
    a, b = _coefficients(n)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(shingles), 4096):
        part = shingles[s:s + 4096]
        for k in range(0, n, 16):
            v = (part[None, :] * a[k:k + 16, None] + b[k:k + 16, None]) >> np.uint64(32)
            np.minimum(out[k:k + 16], v.min(1).astype(np.uint32), out=out[k:k + 16])
    return out


def _sketches(trees: int, depth: int, d: int):
    n = trees * depth
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("short", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    s = words.shingle_set(t.as_py())
                    if len(s):
                        sig = signature(s, n)
                        short = sig.reshape(trees, depth)[:, :d].astype(np.uint16)
                        yield i, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes(), short.tobytes()
                    else:
                        yield i, None, None, None
        yield from batched(rows(), schema)

    return run, "doc_id long, digest binary, sig binary, short binary"


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def _forest(n: int, same) -> np.ndarray:
    """Smallest member index of each member's component. ``same(lo, hi)``
    gives a boolean matrix of members lo..hi against all; symmetric."""
    root = np.arange(n)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        x, y = np.nonzero(same(lo, hi))
        x += lo
        while len(x):
            a, b = root[x], root[y]
            differ = a != b
            if not differ.any():
                break
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            root = _roots(root)
    return root


def _meet(n: int, agree: float):
    """Members of a prefix -> links (member, first member of its group)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for g in runs(batches, ["prefix", "x", "y"]):
                ids = g.column("rep").to_numpy()
                sig = np.frombuffer(b"".join(g.column("short").to_pylist()), np.uint16).reshape(len(ids), n)
                if len(ids) < 2:
                    continue
                root = _forest(len(ids), lambda lo, hi, s=sig: _agreement(s[lo:hi], s) >= agree * n)
                for i in np.nonzero(root != np.arange(len(ids)))[0]:
                    yield int(ids[i]), int(ids[root[i]])
        yield from batched(rows(), schema)

    return run, "a long, b long"


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(y) <= 64:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        out += x[:, k, None] == y[None, :, k]
    return out


def _verify(threshold: float):
    """Members of a candidate group (x <= y: blocks of it) -> one row for each
    member: its links inside this pair of blocks, and the spanning forest."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for g in runs(batches, ["component", "x", "y"]):
                ids = g.column("rep").to_numpy()
                mine = g.column("block").to_numpy() == g.column("x")[0].as_py()
                twice = g.column("x")[0].as_py() != g.column("y")[0].as_py()
                copies = g.column("n_copies").to_numpy()
                sets = [words.shingle_set(t.as_py()) for t in g.column("text")]
                shared = _intersections(sets)
                size = np.array([len(s) for s in sets])
                links = np.zeros(len(ids), np.int64)

                def same(lo, hi, shared=shared, size=size, mine=mine, twice=twice, links=links, copies=copies):
                    i = shared(lo, hi)
                    # i / union >= threshold, in doubles, as SQL divides
                    ok = i / (size[lo:hi, None] + size[None, :] - i) >= threshold
                    ok[np.arange(hi - lo), np.arange(lo, hi)] = False
                    if twice:
                        ok &= mine[lo:hi, None] != mine[None, :]
                    links[lo:hi] = ok.astype(np.int64) @ copies
                    return ok

                root = _forest(len(ids), same)
                for i in range(len(ids)):
                    yield int(ids[i]), int(ids[root[i]]), int(links[i])
        yield from batched(rows(), schema)

    return run, "rep long, root long, links long"


def _intersections(sets: list[np.ndarray], width: int = 8192):
    """(lo, hi) -> sizes of the intersections of sets lo..hi with all. Only
    shingles held by two sets or more are multiplied, ``width`` at a time."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets)
    _, code, held = np.unique(flat, return_inverse=True, return_counts=True)
    in_all = held == n
    number = np.cumsum((held > 1) & ~in_all) - 1
    keep = ((held > 1) & ~in_all)[code]
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common, total = int(in_all.sum()), int(number[-1]) + 1 if len(number) else 0

    def shared(lo: int, hi: int) -> np.ndarray:
        out = np.full((hi - lo, n), common, np.int64)
        for s in range(0, total, width):
            p, q = np.searchsorted(code, [s, s + width])
            m = np.zeros((n, min(width, total - s)), np.float32)
            m[owner[p:q], code[p:q] - s] = 1
            out += np.rint(m[lo:hi] @ m.T).astype(np.int64)
        return out

    return shared


def _blocked(df: DataFrame, group: str, size: DataFrame, block: int, salts: int = 4) -> DataFrame:
    """Rows of groups with over ``block`` rows (``size``: group, n), each once
    for every pair (x <= y) of blocks that it takes part in."""
    many = salted(size.select(group, F.ceil(F.col("n") / block).cast("int").alias("blocks")), salts)
    j = df.withColumn("_salt", salt_of("rep", salts=salts)).join(many, [group, "_salt"]).drop("_salt")
    j = j.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return j.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "blocks")


def representatives(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD,
                    recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, digest; reps: digest, rep, class, n_copies, sig, short),
    both written. ``short``: 16 bits of every value a shortened prefix uses."""
    run, schema = _sketches(trees, depth, prefix_length(threshold, trees, depth, recall))
    rows = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "jj-rows")
    reps = rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("class"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("short").alias("short"))
    return rows.select("doc_id", "digest"), stored(reps.withColumn("rep", F.xxhash64("digest")), "jj-reps")


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components hold every pair at the threshold."""
    d = prefix_length(threshold, trees, depth, recall)
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * (4 * depth) + 1, F.lit(4 * d))))
    keys = reps.select("rep", F.explode(label).alias("prefix"))
    size = keys.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    met = _blocked(keys, "prefix", size, block)
    run, schema = _meet(trees * d, threshold - SLACK)
    members = met.join(reps.select("rep", "short"), "rep").repartition("prefix", "x", "y")
    return (members.sortWithinPartitions("prefix", "x", "y", "short")
            .select("prefix", "x", "y", "rep", "short").mapInArrow(run, schema))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                 recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """See the module's text. Reads ``doc_id`` (long) and ``text``."""
    ready(docs.sparkSession)
    rows, reps = representatives(docs, trees, depth, threshold, recall)
    groups = components(candidate_links(reps, threshold, trees, depth, recall, block))
    groups = stored(groups.select(F.col("node").alias("rep"), "component"), "jj-groups")

    # one text of each representative in a group: the row with the smallest doc_id
    members = reps.join(groups, "rep").select("rep", "class", "digest", "n_copies", "component")
    size = members.groupBy("component").agg(F.count("*").alias("n"))
    texts = _texts(docs, members, rows)
    cut = _blocked(texts, "component", size, max(2, block // 4))
    run, schema = _verify(threshold)
    found = stored(cut.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "rep")
                   .select("component", "x", "y", "block", "rep", "n_copies", "text").mapInArrow(run, schema), "jj-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    tagged = (reps.select("rep", "digest", "class", "n_copies").join(links, "rep", "left")
              .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    least = tagged.groupBy("component").agg(F.min("class").alias("class_id"))
    tagged = tagged.join(least, "component").select(
        "digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "n_copies")
    out = rows.withColumn("_salt", salt_of("doc_id")).join(salted(tagged), ["digest", "_salt"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def _texts(docs: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """``members`` with the text of each, found by its smallest doc_id (by its
    digest, if all its rows have a null doc_id). Only where doc_ids repeat, the
    digest has to tell which of the rows is meant."""
    t = docs.select("doc_id", "text")
    cols = ["rep", "n_copies", "component", "text"]
    named = t.join(members.where("class is not null").withColumnRenamed("class", "doc_id"), "doc_id")
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        named = _matching(named.select(*cols, "digest")).dropDuplicates(["rep"])
    unnamed = members.where("class is null")
    if unnamed.isEmpty():
        return named.select(cols)
    other = t.where("doc_id is null").select("text").mapInArrow(_digests, "digest binary, text string").join(unnamed, "digest").dropDuplicates(["rep"])
    return named.select(cols).union(other.select(cols))


def _digest(text: str | None) -> bytes | None:
    s = words.shingle_set(text)
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = [_digest(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), b.column("text")], names=["digest", "text"])


def _matching(named: DataFrame) -> DataFrame:
    """Rows whose text has the digest they were joined for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [_digest(t.as_py()) == d for t, d in zip(b.column("text"), b.column("digest").to_pylist(), strict=True)]
            yield b.filter(pa.array(same, pa.bool_()))
    return named.mapInArrow(run, named.schema)


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each class: the row with the smallest
    doc_id (nulls last), and the first of several such. Rows are told apart by
    their number in the scan, so repeated and null doc_ids do not matter.
    ``docs`` is a table of files: every pass numbers its rows alike."""
    rows = docs.withColumn("_jj_row", F.monotonically_increasing_id())
    found = jaccard_join(rows.select(F.col("_jj_row").alias("doc_id"), "text"), **kw)
    found = found.select(F.col("doc_id").alias("_jj_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_jj_row"))
    stay = rows.select("_jj_row", "doc_id").join(found, "_jj_row").groupBy("class_id").agg(first.alias("f"))
    return rows.join(stored(stay.select("f._jj_row"), "jj-stay"), "_jj_row", "left_semi").select(docs.columns)
