"""A kept substring index of the message list (P2): trigrams with exact verification.

``SubstringIndex(spark, path)`` keeps two tables under ``path``, both written once
for each batch of messages (a replayed batch replaces what it wrote):

* ``postings``: messages are numbered in *blocks* of a few thousand, and a row has the
  numbers of a block's messages that hold a gram in a field: gram, field, id (the
  block's), n (how many), at (the gaps between the numbers, a byte or two each).
  It is partitioned by a hash ``bucket`` of the gram and by batch, sorted by gram, so
  a lookup prunes buckets and then row groups. In bucket -1, a row for each block
  has the ids of its messages;
* ``counts``: how many messages of a batch have a gram.

``search(emails, text)`` returns what ``list_filter(emails, search=text)`` does. The
text's own ``%`` and ``_`` are wildcards, so it falls into literal parts, and each of
their trigrams must be in the field that matches. The ``RAREST`` ones, by the counts,
are looked up; ids that have them all in one field are candidates; and the pattern
itself decides on the candidates' rows. Up to ``FEW`` candidates are broadcast to the
rows. Of more, whole rows would move to meet them: instead the ids of the rows that
match meet the candidates when the search is set up, and those that are none (of
messages that were not added) are taken from the rows. The index only rules rows out, so its state
never shows in the result but for messages that were not added yet.

Both sides are lower-cased by Spark, as its own ``ilike`` does.

Defined cases: a text without a part of three characters has no trigram, and falls
back to the scan; an empty one is no filter; null fields have no trigrams; ids are
message ids, and messages without one are not found; an index without batches finds
nothing. Subject and sender of a message do not change; a removed message's postings
stay and find no row. A gram that very many messages share (a common word) gives as
many candidates, and is looked up only if the text has no rarer ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .listing import list_filter

FIELDS = ("subject", "sender_email", "sender_name")
BUCKETS = 64
PARTS = 8  # tasks that write one bucket: raise it with the size of a batch
RAREST = 4
FEW = 100_000  # candidates that are broadcast
BLOCK = 4096  # messages of a block, at most 2^14
CHARS = 1 << 20  # characters of a block, beyond one message
_MEMBERS = -1  # the bucket of the blocks' ids
_BLOCKS = "gram string, field int, id string, n int, at binary, ids array<string>"
_POSTINGS = f"{_BLOCKS}, bucket int, batch int"
_COUNTS = "gram string, n long, bucket int, batch int"


def _bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, fields) of a partition, some thousands at a time."""
    held, chars = [], 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            held.append(row)
            chars += sum(len(t) for t in row[1:] if t)
            if len(held) >= BLOCK or chars >= CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _grams(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All runs of three characters: (grams, where the numbers of each begin, the
    numbers of the texts that have it)."""
    size = np.array([len(t or "") for t in texts])
    of = np.repeat(np.arange(len(texts)), size)
    c = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    whole = of[2:] == of[:-2]
    key, of = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole], of[:-2][whole]
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    once = new | np.concatenate([[True], of[1:] != of[:-1]])[:len(key)]
    key, of, start = key[once], of[once], np.flatnonzero(new[once])
    return ["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in key[start].tolist()], start, of


def _packed(start: np.ndarray, of: np.ndarray) -> list[bytes]:
    """Ascending numbers of each run as gaps of 7 bits a byte, low bits first."""
    gap = np.diff(of, prepend=0)
    gap[start] = of[start]
    long = gap >= 128
    at = np.cumsum(long + 1) - long - 1
    out = np.zeros(len(gap) + long.sum(), np.uint8)
    out[at] = gap & 127 | long << 7
    out[at[long] + 1] = gap[long] >> 7
    raw, begin = out.tobytes(), [*at[start].tolist(), len(out)]
    return [raw[b:e] for b, e in zip(begin[:-1], begin[1:], strict=True)]


def _numbers(packed: bytes) -> np.ndarray:
    x = np.frombuffer(packed, np.uint8).astype(np.int64)
    low = np.concatenate([[True], x[:-1] < 128])[:len(x)]  # not the second byte of a gap
    gap = x[low] & 127
    second = np.flatnonzero(~low)
    gap[np.cumsum(low)[second] - 1] += x[second] << 7
    return np.cumsum(gap)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, rows in enumerate(_blocks(batches)):
        ids, *texts = zip(*rows, strict=True)
        name = f"{part}-{k}"
        yield _rows([None], [None], name, [len(ids)], [None], [list(ids)])
        for field, of_field in enumerate(texts):
            grams, start, of = _grams(of_field)
            if grams:
                n = np.diff(start, append=len(of)).tolist()
                yield _rows(grams, [field] * len(grams), name, n, _packed(start, of), [None] * len(grams))


def _rows(gram, field, name, n, at, ids) -> pa.RecordBatch:
    columns = (gram, pa.string()), (field, pa.int32()), ([name] * len(n), pa.string()), (n, pa.int32()), (at, pa.binary()), (ids, pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["gram", "field", "id", "n", "at", "ids"])


def _common(grams: int):
    """The numbers that all of some grams have, in one block and field."""
    def run(t: pa.Table) -> pa.Table:
        have: dict[str, np.ndarray] = {}
        for gram, at in zip(t.column("gram").to_pylist(), t.column("at").to_pylist(), strict=True):
            have[gram] = np.union1d(have[gram], _numbers(at)) if gram in have else _numbers(at)
        all_of = None
        for numbers in have.values():
            all_of = numbers if all_of is None else np.intersect1d(all_of, numbers)
        both = all_of.tolist() if len(have) == grams else []
        return pa.table({"batch": t.column("batch")[:1], "id": t.column("id")[:1], "at": pa.array([both], pa.list_(pa.int32()))})

    return run


def literal_grams(lowered: str) -> list[str]:
    """Trigrams of the literal parts between the wildcards of a search text."""
    return sorted({part[i:i + 3] for part in re.split("[%_]", lowered) for i in range(len(part) - 2)})


class SubstringIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, parts: int = PARTS):
        self.spark, self.path, self.buckets, self.parts = spark, path.rstrip("/"), buckets, parts

    def add(self, emails: DataFrame, batch: int) -> None:
        """Index the messages of a batch. It reads nothing that is stored."""
        # in order, so that a task that is repeated numbers its messages alike
        rows = emails.where("id is not null").select("id", *[F.lower(f).alias(f) for f in FIELDS]).sortWithinPartitions("id", *FIELDS)
        bucket = F.when(F.col("gram").isNull(), F.lit(_MEMBERS)).otherwise(_bucket("gram", self.buckets))
        rows = rows.mapInArrow(_postings, _BLOCKS).withColumns({"bucket": bucket, "batch": F.lit(batch)})
        # the block in the key deals out a bucket's common grams; a task sorts its part by gram
        self._put(rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(self.parts))).sortWithinPartitions("bucket", "gram", "id"), "postings", batch)
        stored = self._read("postings", _POSTINGS).where((F.col("batch") == batch) & (F.col("bucket") != _MEMBERS))
        self._put(stored.groupBy("gram", "bucket", "batch").agg(F.sum("n").alias("n"))
                  .repartition("bucket").sortWithinPartitions("bucket", "gram"), "counts", batch)

    def _put(self, df: DataFrame, name: str, batch: int) -> None:
        """One folder for each batch, replaced as a whole."""
        df.drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str, ddl: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(ddl).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _of(self, name: str, ddl: str, grams: list[str]) -> DataFrame | None:
        """A table's rows of some grams: buckets pruned, grams pushed to the scan."""
        rows = self._read(name, ddl)
        if rows is None:
            return None
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = [r[0] for r in wanted.select(_bucket("gram", self.buckets)).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def candidates(self, lowered: str) -> DataFrame | None:
        """Ids of the messages that may match a lower-cased text (None: any may)."""
        return self._candidates(lowered)[0]

    def _candidates(self, lowered: str) -> tuple[DataFrame | None, int]:
        """(candidates, how many there are at most)."""
        grams = literal_grams(lowered)
        if not grams:
            return None, 0
        none = self.spark.createDataFrame([], "id string")
        counts = self._of("counts", _COUNTS, grams)
        if counts is None:
            return none, 0
        known = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()  # one row for a gram of the text
        if len(known) < len(grams):
            return none, 0
        rare = [r.gram for r in known[:RAREST]]
        hits = self._of("postings", _POSTINGS, rare).select("batch", "id", "field", "gram", "at")
        found = hits.groupBy("batch", "id", "field").applyInArrow(_common(len(rare)), "batch int, id string, at array<int>")
        members = self._read("postings", _POSTINGS).where(F.col("bucket") == _MEMBERS).select("batch", "id", "ids")
        ids = found.join(members, ["batch", "id"]).select(F.explode(F.transform("at", lambda i: F.get("ids", i))).alias("id"))
        return ids.distinct(), known[0].n

    def search(self, emails: DataFrame, text: str, **filters) -> DataFrame:
        """The rows of ``list_filter(emails, search=text, **filters)``."""
        rows = list_filter(emails, search=text, **filters)
        if not text:
            return rows
        lowered = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        ids, most = self._candidates(lowered)
        if ids is None:
            return rows
        if most <= FEW:
            return rows.join(F.broadcast(ids), "id", "left_semi")
        strangers = written(rows.select("id").where("id is not null").join(ids, "id", "left_anti").distinct(), "strangers")  # commonly none
        return rows.where("id is not null").join(F.broadcast(strangers) if strangers.count() <= FEW else strangers, "id", "left_anti")
