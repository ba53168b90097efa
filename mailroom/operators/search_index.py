"""A kept search index that follows a growing table (C3).

``SearchIndex(spark, path, keys)`` holds blocks of documents and their token
bounds (see topk_kernel) as tables under ``path``:

* ``add(terms, batch)`` lays out the documents of one batch, as blocks of its
  own, and writes them and their bounds. It reads nothing that is stored.
* ``delete(gone, batch)`` writes the removed documents' keys (or some columns of
  the key, and any rest of it) as *tombstones*. They hold for documents of earlier
  batches, so a key may come back later, with its new text.
* A search merges on read: tombstoned documents are anti-joined away before they
  are scored. Bounds stay as they are, since a maximum over more documents is a
  bound over fewer; so deletes never touch blocks.
* ``compact()`` lays out the live documents anew, as a generation without
  tombstones. A reader takes the newest generation that is named as whole; the
  older one stays for readers that began with it, and may be removed after.

Batch numbers order adds and deletes: within one batch, the deletes come first.
Repeating a batch with the same number replaces what it wrote, and one that a
generation was made from does nothing: a micro-batch that is replayed adds
nothing. One writer at a time; readers at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import fanout_partitions
from ..session import written
from .topk_kernel import arranged, bundled, leading_blocks, packed, token_bounds

CHUNK_KEY_DDL = "upload_id long, chunk_index int"
# Blocks of one batch: 2^20 partitions of blocks of 256 in 2^33 rows.
_BLOCKS_A_BATCH = 2 ** 45
COMPACTED = 0  # the batch number of what a generation begins with


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, ddl: str = CHUNK_KEY_DDL):
        self.spark, self.path = spark, path.rstrip("/")
        self.key_schema = T.StructType.fromDDL(ddl)
        self.keys = [f.name for f in self.key_schema.fields]
        self._made: dict[str, tuple[list[str], DataFrame]] = {}

    # ------------------------------------------------------------ writing

    def add(self, terms: DataFrame, batch: int) -> None:
        """terms(keys, tok, n, n2), partitioned by key: the documents of a batch (numbered from 1)."""
        if batch <= COMPACTED:
            raise ValueError("batches are numbered from 1")
        generation, covered = self._current()
        if batch > covered:
            self._put(packed(terms, self.keys), batch, generation, fanout_partitions(terms))

    def _put(self, docs: DataFrame, batch: int, generation: int, shards: int) -> None:
        base = f"{self.path}/generation={generation}"
        laid = arranged(docs, self.keys, shards).withColumn("block", F.col("block") + F.lit(batch * _BLOCKS_A_BATCH))
        part = f"{base}/documents/batch={batch}"
        laid.write.mode("overwrite").parquet(part)
        docs = self.spark.read.schema(laid.schema).parquet(part)
        token_bounds(docs).write.mode("overwrite").parquet(f"{base}/bounds/batch={batch}")

    def delete(self, gone: DataFrame, batch: int) -> None:
        """gone(some or all of the keys): documents of earlier batches to remove."""
        cols = [c for c in self.keys if c in gone.columns]
        if not cols:
            raise ValueError(f"deletions need one of {self.keys}")
        generation, covered = self._current()
        if batch > covered:
            gone.select(*cols).distinct().write.mode("overwrite").parquet(
                f"{self.path}/generation={generation}/tombstones/{'-'.join(cols)}/batch={batch}")

    def compact(self) -> None:
        """Live documents as the first batch of a new generation."""
        generation, covered = self._current()
        live = self.documents()
        last = self._last_batch(covered)
        self._put(live.drop("block"), COMPACTED, generation + 1, fanout_partitions(live))
        named = self.spark.range(1).select(F.lit(generation + 1).cast("long").alias("generation"), F.lit(last).cast("long").alias("covered"))
        named.write.mode("append").parquet(f"{self.path}/current")  # from now on readers see it

    # ------------------------------------------------------------ reading

    def _read(self, path: str, schema: T.StructType) -> DataFrame | None:
        """A table that may not have been written yet (None)."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _current(self) -> tuple[int, int]:
        """(newest whole generation, the last batch that went into it)."""
        named = self._read(f"{self.path}/current", T.StructType.fromDDL("generation long, covered long"))
        if named is None:
            return 0, 0
        return tuple(named.agg(F.max(F.struct("generation", "covered")).alias("c")).select("c.*").first())

    def _shapes(self) -> list[list[str]]:
        """The key columns that tombstones may name."""
        return [[c for i, c in enumerate(self.keys) if n >> i & 1] for n in range(1, 2 ** len(self.keys))]

    def _tombstones(self, cols: list[str]) -> DataFrame | None:
        schema = T.StructType([*[f for f in self.key_schema.fields if f.name in cols], T.StructField("batch", T.LongType())])
        return self._read(f"{self._base()}/tombstones/{'-'.join(cols)}", schema)

    def _last_batch(self, covered: int) -> int:
        """The last batch that is written, from the folders' names alone."""
        tables = [self._documents(), *[self._tombstones(cols) for cols in self._shapes()]]
        return max([covered, *[t.agg(F.max("batch")).first()[0] or 0 for t in tables if t is not None]])

    def _base(self) -> str:
        return f"{self.path}/generation={self._current()[0]}"

    def _documents(self) -> DataFrame | None:
        schema = T.StructType([*self.key_schema.fields, *T.StructType.fromDDL(
            "toks array<string>, ns array<long>, n2 long, block long, batch long").fields])
        return self._read(f"{self._base()}/documents", schema)

    def documents(self) -> DataFrame:
        """Live documents (keys, toks, ns, n2, block)."""
        docs = self._documents()
        if docs is None:
            return self.spark.createDataFrame([], T.StructType([*self.key_schema.fields, *T.StructType.fromDDL(
                "toks array<string>, ns array<long>, n2 long, block long").fields]))
        for cols in self._shapes():
            dead = self._tombstones(cols)
            if dead is not None:
                until = dead.groupBy(*cols).agg(F.max("batch").alias("_until"))
                docs = docs.join(until, cols, "left").where(F.col("_until").isNull() | (F.col("batch") >= F.col("_until"))).drop("_until")
        return docs.drop("batch")

    def _once(self, name: str, of: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written when the first search after an add, a delete or a
        compaction asks for it: files are never changed, so the same files hold the same rows."""
        files = sorted(of.inputFiles())
        if name not in self._made or self._made[name][0] != files:
            self._made[name] = files, written(make(), name)
        return self._made[name][1]

    def bundles(self) -> DataFrame:
        """Live documents as compressed bundles."""
        docs = self.documents()
        return self._once("search-held", docs, lambda: bundled(
            docs.repartition(fanout_partitions(docs), "block").sortWithinPartitions("block"), self.keys))

    def leading(self) -> DataFrame:
        """(block, tok, most): of each token only the block where it weighs most."""
        return self._once("search-leading", self.bounds(), lambda: leading_blocks(self.bounds()))

    def bounds(self) -> DataFrame:
        schema = T.StructType.fromDDL("block long, tok string, most double")
        got = self._read(f"{self._base()}/bounds", schema)
        return self.spark.createDataFrame([], schema) if got is None else got
