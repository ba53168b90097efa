"""Benchmark decontamination: size-partitioned MinHash containment search.

``contained(docs, items)`` finds the pairs of a document and a benchmark item
of whose distinct five-word shingles the document holds at least 0.8, however
long the document is and wherever they stand in it. One row for each pair:

============  ===================================================================
doc_id        as given (one row for each document row, should a row repeat)
item_id       as given
n_shared      long: the item's distinct shingles found in the document
n_item        long: the item's distinct shingles
containment   double: n_shared / n_item
============  ===================================================================

How it works
  A MinHash comparison of whole sets fails here: the Jaccard similarity of a
  20-shingle item and a 20,000-shingle document is 0.001 even if the item is
  contained. So the *items* are put in size partitions (shingle counts between
  powers of two), and each partition has its own sketch length: the bottom-k
  MinHash sketch of an item keeps its ``k`` smallest shingle hashes, with
  ``k = n - ceil(0.8 n) + 1`` at the partition's largest size n. A document that
  holds 0.8 of the item lacks fewer than ``k`` of its shingles and therefore
  holds one of the sketch: candidate search has recall 1, with no false-negative
  rate to tune. Document hashes above the partitions' largest sketch value are
  skipped at once; the others are looked up in the sketch index. Each candidate
  is verified on its whole shingle set.

  The items are read in blocks of at most ``block`` shingles in all (a stated
  bound, 4 million: about 64 MB with the index), and every block is broadcast and
  run against all documents, which are scanned, never shuffled. A larger
  benchmark takes more blocks, not larger ones.

Defined cases: null and empty documents and items match nothing; items and
documents of 1 to 4 words have one shingle of all their words; equal items are
reported each under its item_id; a null item_id is reported as such; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .util import batched, ready, stored

THRESHOLD = 0.8
BLOCK = 4_000_000
_FILTER_BITS = 20


def sketch_length(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch values that an item of ``n`` shingles needs so that a document
    with ``threshold`` of them always holds one."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def size_partition(n: int) -> int:
    """Largest size of the partition that an item of n shingles belongs to."""
    return 1 << (n - 1).bit_length()


class Index:
    """Sketches of one block of items, sorted for lookup, and their full sets."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.threshold = threshold
        sketch = [s[:sketch_length(size_partition(len(s)), threshold)] for s in sets]  # sorted: the smallest
        self._hash = np.concatenate(sketch)
        self._item = np.repeat(np.arange(len(sets)), [len(s) for s in sketch])
        order = np.argsort(self._hash, kind="stable")
        self._hash, self._item = self._hash[order], self._item[order]
        self._largest = self._hash[-1]
        self._seen = np.zeros(1 << _FILTER_BITS, bool)
        self._seen[self._low(self._hash)] = True
        self.sets = sets

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, n_shared) of the items that a text's shingles contain."""
        h = shingles[shingles <= self._largest]
        h = h[self._seen[self._low(h)]]
        if len(h) == 0:
            return []
        h = np.unique(h)
        lo, hi = np.searchsorted(self._hash, h, "left"), np.searchsorted(self._hash, h, "right")
        hit = np.nonzero(hi > lo)[0]
        if len(hit) == 0:
            return []
        candidates = np.unique(np.concatenate([self._item[lo[i]:hi[i]] for i in hit]))
        whole, out = np.unique(shingles), []
        for c in candidates:
            s = self.sets[c]
            at = np.searchsorted(whole, s)
            n = int((whole[np.minimum(at, len(whole) - 1)] == s).sum())
            if n / len(s) >= self.threshold:
                out.append((int(c), n))
        return out


def _blocks(items: DataFrame, block: int) -> Iterator[DataFrame]:
    """Items in blocks of at most ``block`` characters' worth of shingles: an
    item has no more shingles than half its characters, plus one."""
    sized = stored(items.select("item_id", "text").where("text is not null").withColumn(
        "most", (F.length("text") / 2 + 1).cast("long")), "items")
    total = sized.agg(F.sum("most")).first()[0] or 0
    n = max(1, math.ceil(1.25 * total / block)) if total > block else 1
    for k in range(n):
        yield sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).drop("most")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """See the module's text. ``docs``: doc_id (long), text; ``items``: item_id
    (long), text."""
    spark = docs.sparkSession
    ready(spark)
    out = None
    for part in _blocks(items, block):
        rows = part.collect()  # bounded by ``block``
        sets = [words.shingle_set(r["text"]) for r in rows]
        ids = [r["item_id"] for r, s in zip(rows, sets, strict=True) if len(s)]
        sets = [s for s in sets if len(s)]
        if not sets:
            continue
        held = spark.sparkContext.broadcast((ids, Index(sets, threshold)))
        found = docs.select("doc_id", "text").mapInArrow(_search(held), _PAIRS)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], _PAIRS) if out is None else out


_PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _search(held):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()),
                        ("n_item", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = held.value

        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    for c, n in index.search(words.shingle_hashes(t.as_py())):
                        size = int(index.size[c])
                        yield i, ids[c], n, size, n / size
        yield from batched(rows(), schema)

    return run


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs``, all columns, without the rows that contain an item. Every row
    is judged by its own text, so null and repeated doc_ids need no key."""
    spark = docs.sparkSession
    ready(spark)
    for part in _blocks(items, block):
        sets = [s for r in part.collect() if len(s := words.shingle_set(r["text"]))]
        if sets:
            docs = docs.mapInArrow(_without(spark.sparkContext.broadcast(Index(sets, threshold))), docs.schema)
    return docs


def _without(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            yield b.filter(pa.array([not index.search(words.shingle_hashes(t.as_py())) for t in b.column("text")], pa.bool_()))

    return run
