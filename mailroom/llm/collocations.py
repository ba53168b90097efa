"""Phrase collocations by set-oriented (SETM) mining of occurrence relations.

``collocations(docs)`` returns the phrases of 2 to ``longest`` words that occur
``least`` times or more in a language and stick together best: lang, rank (from
1), phrase (words joined by a space), a, l, r, n, score (all long).

A text is lower-cased (A-Z only) and split at ``. , ; : ! ?`` and line breaks
into *pieces*, and these at blanks and tabs into words. All counts are per lang
(null: ``und``): ``n`` words in all, ``a`` = f(phrase) contiguous occurrences
within pieces, overlaps included. Cutting a phrase after its first k words gives
``l`` = f(first part), ``r`` = f(rest) and floor(1000 * a * n / (l * r)); the
lowest-scoring cut counts, ties to the smallest k. A phrase whose words lie
inside a longer one with 100 * f(longer) >= ``covered`` * a is left out.

How it works
  1. Words are counted; those with ``least`` occurrences are the *frequent
     groups* of length 1, each with a number of its own.
  2. The *occurrence relation* of length 1 holds (piece, pos, id) of frequent
     words. It is persisted as a table bucketed by piece and sorted by (piece,
     pos); this is the only time that occurrences move.
  3. A relation is *merge-joined* with itself by piece and adjacent position: an
     occurrence of k words at pos and one at pos + 1 overlap in k - 1 words, and
     make one of k + 1. Both sides lie in the same bucket, so the join shuffles
     nothing, and its sorts find rows in order.
  4. Its (left, right) ids are *group-counted* (partial aggregate); groups with
     ``least`` occurrences are frequent and get numbers.
  5. The joined rows are *semi-joined* to the frequent groups before they are
     persisted as the relation of length k + 1, so infrequent ones never extend.
     Every part of a frequent phrase is frequent, so nothing is lost. The groups
     are broadcast up to ``SMALL`` bytes (summed before); more of them meet the
     occurrences by a shuffle with a salt.
  6. Scores are exact: Python integers, over the frequent groups alone.

Ids stand for (lang, word) or pairs of ids, never for hashes: counts are exact.

Defined cases: null and empty texts have no words; a null lang is ``und`` and
falls together with a literal ``und``; a repeated row counts each time; null
doc_ids do not matter, since only lang and text are read; a piece of one word
has no phrase; an empty table, and one without frequent words, gives an empty
result; further columns are ignored. ``docs`` is a table of files: pieces are
numbered in the scan that writes the first relation.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .util import ready, salt_of, salted, stored

LEAST = 100
LONGEST = 5
COVERED = 100
TOP = 2000
SMALL = 32 << 20  # bytes of frequent groups that are broadcast, beyond it they are shuffled
WORDS_A_BUCKET = 2_000_000
MOST_BUCKETS = 100_000  # Spark's own bound on the buckets of a table
_ENDS = ".,;:!?\x0b\x0c\r"
_FROM = string.ascii_uppercase + _ENDS + "\t"
_TO = string.ascii_lowercase + "\n" * len(_ENDS) + " "


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words): the words of each piece, in order; empty pieces left out."""
    text = F.translate("text", _FROM, _TO)
    cut = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "\n", -1)).alias("piece"))
    return cut.select("lang", F.array_remove(F.split("piece", " ", -1), "").alias("words")).where(F.size("words") > 0)


def _numbered(groups: DataFrame, name: str) -> DataFrame:
    """Frequent groups with a number each, written once."""
    return stored(groups.withColumn("id", F.monotonically_increasing_id()), name)


def _semi(rows: DataFrame, groups: DataFrame, keys: list[str], buckets: int, small: int) -> DataFrame:
    """(piece, pos, id) of the rows whose keys are a frequent group."""
    cols = ["piece", "pos", "id"]
    groups = groups.select(*keys, "id")
    each = sum((F.octet_length(k) for k in keys if groups.schema[k].dataType.typeName() == "string"), F.lit(32))
    if (groups.agg(F.sum(each)).first()[0] or 0) <= small:
        return rows.join(F.broadcast(groups), keys).select(cols)
    # a word or a pair may hold a third of all rows: the groups meet it under every salt
    met = rows.withColumn("_salt", salt_of("piece", "pos")).join(salted(groups).hint("merge"), [*keys, "_salt"])
    return met.select(cols).repartition(buckets, "piece")


class _Relations:
    """Occurrence relations as bucketed tables, and their names."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def persist(self, occurrences: DataFrame, k: int) -> DataFrame:
        name = f"occurrences_{k}_{uuid.uuid4().hex[:12]}"
        path = scratch_path(self.spark, f"co-relation-{k}")
        (occurrences.write.bucketBy(self.buckets, "piece").sortBy("piece", "pos").format("parquet")
         .option("path", path).saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _extended(relation: DataFrame) -> DataFrame:
    """(piece, pos, left, right): the merge join by piece and adjacent position."""
    left = relation.select("piece", "pos", F.col("id").alias("left"))
    right = relation.select("piece", (F.col("pos") - 1).alias("pos"), F.col("id").alias("right"))
    return left.join(right.hint("merge"), ["piece", "pos"])


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k: its words, a) of all phrases of 1 to ``longest`` words
    with ``least`` occurrences or more, and (lang, n) of the words in all."""
    spark = docs.sparkSession
    words = pieces(docs)
    counts = stored(words.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("a")), "co-words")
    totals = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), "co-totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // WORDS_A_BUCKET)))
    group = _numbered(counts.where(F.col("a") >= least), "co-frequent-1").withColumns({"phrase": F.col("word"), "last": F.col("word")})
    levels = [group]
    placed = words.withColumn("piece", F.monotonically_increasing_id()).select("lang", "piece", F.posexplode("words").alias("pos", "word"))
    relations = _Relations(spark, buckets)
    # buckets by piece serve a join by (piece, pos), and the one file of a bucket is in order
    ours = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {c: spark.conf.get(c) for c in ours}
    for c, v in ours.items():
        spark.conf.set(c, v)
    try:
        relation = relations.persist(_semi(placed, group, ["lang", "word"], buckets, small).repartition(buckets, "piece"), 1)
        for k in range(2, longest + 1):
            joined = _extended(relation)
            found = joined.groupBy("left", "right").agg(F.count("*").alias("a")).where(F.col("a") >= least)
            found = _numbered(found, f"co-groups-{k}")
            first = group.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
            last = group.select(F.col("id").alias("right"), "last")
            named = found.join(first, "left").join(last, "right").withColumn("phrase", F.concat_ws(" ", "head", "last")).drop("head")
            group = stored(named, f"co-frequent-{k}")
            levels.append(group)
            if k == longest or found.isEmpty():
                break
            relation = relations.persist(_semi(joined, found, ["left", "right"], buckets, small), k)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        relations.forget()
    got = [g.select("lang", "phrase", F.lit(k).alias("k"), "a") for k, g in enumerate(levels, 1)]
    out = got[0]
    for g in got[1:]:
        out = out.union(g)
    return out, totals


def _parts(phrases: DataFrame, shortest: int) -> DataFrame:
    """``phrases`` with every contiguous part of ``shortest`` words up to one
    word less than the phrase has."""
    w = F.split("phrase", " ")
    sizes = F.sequence(F.lit(shortest), F.col("k") - 1)
    each = F.flatten(F.transform(sizes, lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    return phrases.withColumn("part", F.explode(F.array_distinct(each)))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of each phrase, in integers of any size."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                        ("n", pa.int64()), ("score", pa.int64())])
    for b in batches:
        rows = []
        for x in b.to_pylist():
            cuts = sorted((1000 * x["a"] * x["n"] // (c["l"] * c["r"]), c["cut"], c["l"], c["r"]) for c in x["cuts"])
            score, _, left, right = cuts[0]
            rows.append((x["lang"], x["phrase"], x["a"], left, right, x["n"], score))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP,
                 small: int = SMALL) -> DataFrame:
    """See the module's text. ``docs``: lang, text, other columns."""
    ready(docs.sparkSession)
    known, totals = frequent(docs, least, longest, small)
    phrases = known.where("k > 1")
    most = _parts(phrases.where("k > 2"), 2).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    own = phrases.join(most, ["lang", "phrase"], "left")
    own = own.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    w = F.split("phrase", " ")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    of = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    # one word may begin or end a third of all phrases
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.withColumn("_salt", salt_of("phrase")).join(
            salted(of.withColumnsRenamed({"part": part, "f": name})), ["lang", part, "_salt"]).drop("_salt")
    each = cuts.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("cut", "l", "r")).alias("cuts"))
    scored = each.join(totals, "lang").select("lang", "phrase", "a", "n", "cuts").mapInArrow(
        _scores, "lang string, phrase string, a long, l long, r long, n long, score long")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
