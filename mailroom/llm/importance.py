"""Importance resampling towards a target distribution, on hashed n-grams.

``resample(docs, target)`` weighs every document by how much more its features
belong to the texts of ``target`` than to ``docs``, and draws ``percent`` % of
the documents of ``least_words`` words or more, without replacement (Gumbel
top-k). It returns one row for each row of ``docs``: doc_id, n_features, weight,
score and rank (1, 2, ... by falling score, ties to the smaller doc_id; null if
undrawn), all long.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z. Features are all runs of 1 to ``order`` words, joined by a space, repeats
counted; a feature's bucket is the unsigned crc32 of its UTF-8 bytes modulo
``BUCKETS``. With S features of docs and T of target, s and t in a bucket, its
gain is floor(1000 * ln((t+1) * (S+BUCKETS) / ((s+1) * (T+BUCKETS)))), in
doubles; a weight is the floored mean of a document's gains (no features: 0).
A score is the weight + floor(-1000 * ln(-ln((h+0.5) / 2^32))), where h is the
first 32 bits of sha256("<seed>:<doc_id>").

How it works (*segment deduplication*)
  1. A newline separates words, so it cuts texts into *lines* without cutting a
     word. Equal lines are one row after a partial aggregate (a line that a third
     of all documents hold is combined before it moves), with their number.
  2. Each *distinct* line's features are counted once and multiplied by its
     occurrences. A task returns the counts of its lines by bucket.
  3. N-grams that cross a newline lie in no line. They are counted from the
     documents, separately (none for order 1, where this pass is left out).
  4. ``BUCKETS`` gains go to a second pass over the documents, which scores the
     distinct lines of a batch once, adds their sums and the crossing n-grams',
     and is written.
  5. The scores' distribution (their range is bounded by the gains') gives the
     score that the last drawn document has; only rows of at least that are sorted
     by range, and get their rank from their place in the sorted partition.

Defined cases: null and empty texts have no features and weight 0; a null doc_id
is hashed as an empty string and sorts after all others; repeated rows have the
same score, and either may be drawn first; ties of score go to the smaller
doc_id; an empty ``docs`` gives an empty result; an empty ``target`` weighs
against it alone (t = T = 0); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import batched, ready, stored

BUCKETS = 10_000
ORDER = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Of UTF-8: every byte of a character beyond ASCII is 0x80 or more.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_REMEMBER = 200_000


class _Remembered(dict):
    """Values by key; the table starts anew when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= _REMEMBER:
            self.clear()
        v = self[key] = self.make(key)
        return v


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


def words_of(line: bytes) -> list[bytes]:
    return _WORDS(line.lower())


def in_line(words: list[bytes], order: int, bucket_of) -> list[int]:
    """Buckets of the runs of 1 to ``order`` words of one line."""
    got = [bucket_of[w] for w in words]
    for n in range(2, order + 1):
        got += [_bucket(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    return got


def crossing(lines: list[list[bytes]], order: int) -> list[int]:
    """Buckets of the runs of 2 to ``order`` words that begin in one line and end in a later one."""
    words = [w for line in lines for w in line]
    of = [k for k, line in enumerate(lines) for _ in line]
    starts = sorted({i for b in range(1, len(words)) if of[b] != of[b - 1] for i in range(max(0, b - order + 1), b)})
    return [_bucket(b" ".join(words[i:i + n])) for n in range(2, order + 1) for i in starts
            if i + n <= len(words) and of[i] != of[i + n - 1]]


def _counted(add) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a task: ``add(total)`` fills an array of all buckets."""
    total = np.zeros(BUCKETS, np.int64)
    add(total)
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def _line_features(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(total):
            bucket_of = _Remembered(_bucket)
            for b in batches:
                for line, times in zip(b.column("line"), b.column("times").to_pylist(), strict=True):
                    got = in_line(words_of(line.as_py().encode()), order, bucket_of)
                    if len(got) > 64:
                        total[:] += np.bincount(got, minlength=BUCKETS) * times
                    else:
                        for k in got:
                            total[k] += times
        yield from _counted(add)
    return run


def _crossing_features(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(total):
            for b in batches:
                for text in b.column("text"):
                    got = crossing([words_of(x) for x in text.as_py().encode().split(b"\n")], order)
                    if got:
                        total[:] += np.bincount(got, minlength=BUCKETS)
        yield from _counted(add)
    return run


def feature_counts(texts: DataFrame, order: int = ORDER) -> np.ndarray:
    """Features of all texts (column ``text``) in each bucket."""
    texts = texts.where("text is not null and text <> ''").select("text")
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    lines = lines.groupBy("line").agg(F.count("*").alias("times"))
    counts = lines.mapInArrow(_line_features(order), "bucket long, n long")
    if order > 1:
        counts = counts.union(texts.mapInArrow(_crossing_features(order), "bucket long, n long"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    big_s, big_t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(big_s + BUCKETS) / (float(s + 1) * float(big_t + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, order: int, seed: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "n_words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Remembered(_bucket)

        def of_line(line: bytes) -> tuple[int, int, int]:
            words = words_of(line)
            got = in_line(words, order, bucket_of)
            return len(words), len(got), int(gain[got].sum()) if got else 0

        def rows():
            for b in batches:
                seen: dict[bytes, tuple[int, int, int]] = {}  # lines of this batch
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    words = n = total = 0
                    lines = (text.as_py() or "").encode().split(b"\n")
                    for line in lines:
                        if (v := seen.get(line)) is None:
                            v = seen[line] = of_line(line)
                        words, n, total = words + v[0], n + v[1], total + v[2]
                    if order > 1:
                        got = crossing([words_of(x) for x in lines], order)
                        n, total = n + len(got), total + (int(gain[got].sum()) if got else 0)
                    weight = total // n if n else 0
                    yield doc_id, n, weight, weight + gumbel(doc_id, seed), words
        yield from batched(rows(), schema)

    return run, "doc_id long, n_features long, weight long, score long, n_words long"


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with their rank by (score descending, doc_id), from ranges that
    are sorted side by side; null beyond ``most``."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ir-sorted")
    part = F.shiftright("at", 33)
    sizes = sorted((p, n) for p, n in placed.groupBy(part).agg(F.count("*")).collect())  # one for each partition
    before, start = 0, {}
    for p, n in sizes:
        start[p], before = before, before + n
    first = rows.sparkSession.createDataFrame(sorted(start.items()) or [(0, 0)], "part long, first long")
    ranked = placed.join(F.broadcast(first), part == F.col("part"))
    rank = F.col("first") + F.col("at").bitwiseAND(2 ** 33 - 1) + 1
    return ranked.withColumn("rank", F.when(rank <= most, rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER,
             seed: int = SEED) -> DataFrame:
    """See the module's text. ``docs``: doc_id (long) and text; ``target``: text."""
    ready(docs.sparkSession)
    gain = gains(feature_counts(docs, order), feature_counts(target, order))
    run, schema = _weigh(gain, order, seed)
    scored = docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "ir-scored")
    enough = F.col("n_words") >= least_words
    # distinct scores are few: gains are within 1000 * ln of the counts, and the noise within 23,000
    spread = sorted(scored.where(enough).groupBy("score").agg(F.count("*")).collect(), reverse=True)
    most = sum(n for _, n in spread) * percent // 100
    lowest, got = None, 0
    for score, n in spread:
        if got >= most:
            break
        lowest, got = score, got + n
    cols = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*cols, F.lit(None).cast("long").alias("rank"))
    may = enough & (F.col("score") >= lowest)
    rest = scored.where(~may).select(*cols, F.lit(None).cast("long").alias("rank"))
    return _ranked(scored.where(may), most).select(*cols, "rank").union(rest)
