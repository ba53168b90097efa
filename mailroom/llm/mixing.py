"""Mixing sources to target weights, on DataFrame and SQL functions only.

``allot(docs)`` decides how often every document is taken and into which output
shard each copy goes; ``mix(docs)`` returns the taken copies themselves, shard
by shard in shuffled order.

Sizes are words: runs of ``[^\\x20\\x09-\\x0D]+``. Sources in code point order,
null last, weigh ``WEIGHTS``, repeating. Together they share ``SHARE`` of all
sizes; a target stops at ``MOST`` times its source's size, and what it does not
take is shared again by weight among the others.

How it works (multivariate-hypergeometric splitting tree)
  1. Each source's documents fall by hash into *blocks* of about
     ``BLOCK_WORDS`` words. The blocks of a source are permuted by a hash. A target of c
     whole passes and a rest takes every block c times and then blocks in
     permuted order until the rest is used up; the last of them is taken up to
     the document that comes closest. That gives each source's exact quota of
     block copies.
  2. *Splitting tree.* The root node holds all shards and the vector of quotas.
     A node's shards are halved; how many of each source's block copies go left
     is drawn from the multivariate hypergeometric distribution (one source after
     the other, each exactly hypergeometric given the others, by inversion from
     the mode outward), and the rest goes right. Leaves are shards: their counts
     are distributed as if all block copies had been shuffled together and dealt
     out, but no row is sorted or moved to get there.
  3. Every shard draws its counts from the sources' permuted blocks, one range
     after the other, so draws are disjoint. ``mix`` moves each copy once, to its
     shard, and shuffles there by a sort on a hash.

All randomness is a hash of ``seed`` and identity (source, doc_id, text), so
reruns, retried tasks and other cluster sizes agree.

Defined cases: null texts have size 0 and are allotted like other rows (they add
no words); a null source is a source of its own, the last; rows that are equal in
doc_id, source and text share one fate; sources of size 0 have target 0; an empty
table gives an empty result; other columns pass through (names with ``_mx`` are
used inside).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import ready, salt_of, salted, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 20_000
SHARD_WORDS = 4_000_000
SEED = 42


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def identity(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds rank, weight and target to (source, source_size): one row for each
    source. The level at which targets stop is found on the sources in order of
    the level at which each of them stops; one row for each source is all that
    meets in a window."""
    everything = Window.partitionBy(F.lit(0))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(ordered) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    s = s.withColumns({"cap": most * F.col("source_size"), "stops": most * F.col("source_size") / F.col("weight"),
                       "total": share * F.sum("source_size").over(everything), "all": F.sum("weight").over(everything)})
    so_far = Window.orderBy("stops", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"caps": F.sum("cap").over(so_far), "open": F.col("all") - F.sum("weight").over(so_far)})
    s = s.withColumn("full", F.col("caps") + F.col("stops") * F.col("open") <= F.col("total"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))) \
        / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))) \
        .select("source", "source_size", "rank", "weight", "target")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL: marked items among ``drawn`` of ``total``, by inversion. Places over
    40 standard deviations from the mode weigh 0 in doubles and are skipped."""
    # names differ in more than case: SQL does not tell N from n
    up = "(mk - k + 1D) * (dr - k + 1D) / (k * (al - mk - dr + k + 0D))"
    down = "(k + 1D) * (al - mk - dr + k + 1D) / ((mk - k + 0D) * (dr - k))"
    above, below = "IF(top > mode, sequence(mode + 1, top), array())", "IF(low < mode, sequence(mode - 1, low), array())"
    add = "(s, k) -> " + _let("v", "s.w * {}", "named_struct('w', v, 't', s.t + v)")
    find = "(s, k) -> " + _let("v", "s.w * {}", "named_struct('w', v, 't', s.t + v, 'x', IF(s.x IS NULL AND goal < s.t + v, k, s.x))")
    first = "named_struct('w', 1D, 't', 1D)"
    body = _let("p", f"aggregate({above}, named_struct('w', 1D, 't', 1D, 'x', IF(goal < 1D, mode, CAST(NULL AS BIGINT))), {find.format(up)})",
                f"coalesce(aggregate({below}, named_struct('w', 1D, 't', p.t, 'x', p.x), {find.format(down)}).x, mode)")
    body = _let("goal", f"{uniform} * (aggregate({above}, {first}, {add.format(up)}).t + aggregate({below}, {first}, {add.format(down)}).t - 1D)", body)
    body = _let("low", "greatest(least_, mode - far)", _let("top", "least(most_, mode + far)", body))
    body = _let("far", "CAST(50 + 40 * sqrt(dr * (mk / greatest(al, 1D)) * (1 - mk / greatest(al, 1D)) * (al - dr) / greatest(al - 1, 1D)) AS BIGINT)", body)
    body = _let("mode", "least(most_, greatest(least_, CAST(floor((dr + 1D) * (mk + 1D) / (al + 2D)) AS BIGINT)))", body)
    body = _let("least_", "greatest(0L, dr - (al - mk))", _let("most_", "least(mk, dr)", body))
    return _let("al", total, _let("mk", marked, _let("dr", drawn, body)))


def split_tree(root: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``root``: one row, quotas (array<bigint>, one for each source) ->
    (shard, quotas) for every shard, summing to the root's."""
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas",
                        F.expr("aggregate(quotas, 0L, (x, y) -> x + y)").alias("all"))
    uniform = f"(pmod(xxhash64({seed}, lo, hi, i), 9007199254740992) / 9007199254740992D)"
    x = _hypergeometric("st.rest", "quotas[i]", "st.n", uniform)
    left = ("aggregate(sequence(0, size(quotas) - 1), named_struct('rest', aggregate(quotas, 0L, (x, y) -> x + y), "
            "'n', CAST(floor((lo + hi) DIV 2 * CAST(all AS DECIMAL(20)) / {m}) - floor(lo * CAST(all AS DECIMAL(20)) / {m}) AS BIGINT), "
            "'got', CAST(array() AS ARRAY<BIGINT>)), (st, i) -> ").format(m=shards)
    left += _let("d", x, "named_struct('rest', st.rest - quotas[i], 'n', st.n - d, 'got', concat(st.got, array(d)))") + ").got"
    left = f"IF(size(quotas) = 0, quotas, {left})"
    mid = "CAST((lo + hi) DIV 2 AS INT)"
    halves = _let("l", left, f"array(named_struct('lo', lo, 'hi', {mid}, 'quotas', l), "
                  f"named_struct('lo', {mid}, 'hi', hi, 'quotas', zip_with(quotas, l, (x, y) -> x - y)))")
    whole = "array(named_struct('lo', lo, 'hi', hi, 'quotas', quotas))"
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % 6 == 0:
            nodes = nodes.repartition("lo")
        pick = f"IF(hi - lo > 1, {halves}, {whole})"
        nodes = nodes.select("all", F.explode(F.expr(pick)).alias("c")).select("all", "c.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def _shards(total_words: float, shard_words: int) -> int:
    return max(1, math.ceil(total_words / shard_words))


def _blocks(meta: DataFrame, src: DataFrame) -> DataFrame:
    """(rank, block, words, place, before): blocks in permuted order."""
    b = meta.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(SEED), "rank", "block"), "block")
    b = b.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return b.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))


class Plan:
    """The quotas of a mix: ``sources`` and ``blocks``, both written."""

    def __init__(self, meta: DataFrame, share: float, most: float, weights, block_words: int, shard_words: int, seed: int):
        sizes = meta.groupBy("source").agg(F.sum("size").alias("source_size"))
        n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("int")
        src = targets(sizes, weights, share, most)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        self.sources = stored(src.withColumns({"n_blocks": n, "passes": passes}).withColumn(
            "rest", F.col("target") - F.col("passes") * F.col("source_size")), "mx-sources")
        total = self.sources.agg(F.sum("target")).first()[0] or 0
        self.shards = _shards(total, shard_words)
        self.meta = stored(with_blocks(meta, self.sources), "mx-meta")
        per = self.sources.select("rank", "passes", "rest", "target")
        blocks = _blocks(self.meta, per).join(per, "rank")
        # a block is cut where the rest ends inside it
        blocks = stored(blocks.withColumns({
            "more": (F.col("before") < F.col("rest")).cast("int"),
            "cut": (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))}), "mx-blocks")
        in_cut = self.meta.join(blocks.where("cut").select("rank", "block", (F.col("rest") - F.col("before")).alias("room")), ["rank", "block"])
        run = Window.partitionBy("rank", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        upto = in_cut.withColumn("so_far", F.sum("size").over(run)).where(F.col("so_far") - F.col("size") / 2 <= F.col("room"))
        upto = upto.groupBy("rank", "block").agg(F.max("key").alias("cut_key"))
        quota = blocks.groupBy("rank").agg(F.sum(F.col("passes") + F.col("more")).cast("long").alias("quota"))
        # every source has a row, so a block: the ranks are the places 0, 1, .. of the quotas
        root = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas"))
        counts = split_tree(root, self.shards, seed).select("shard", F.posexplode("quotas").alias("rank", "n"))
        upward = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        drawn = counts.withColumn("end", F.sum("n").over(upward)).where("n > 0")
        drawn = drawn.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("ordinal"))
        # block copies in the order of the passes over the permuted blocks
        many = blocks.groupBy("rank").agg(F.count("*").alias("many"))
        copies = blocks.join(many, "rank").where("passes + more > 0").select(
            "rank", "block", "place", "passes", "cut", "many", F.explode(F.sequence(F.lit(0), F.col("passes") + F.col("more") - 1)).alias("copy"))
        copies = copies.withColumn("ordinal", F.col("copy") * F.col("many") + F.col("place"))
        placed = copies.join(drawn, ["rank", "ordinal"]).groupBy("rank", "block").agg(
            F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("places"),
            F.max(F.when(F.col("cut"), F.col("passes"))).alias("cut_copy"))
        self.blocks = stored(placed.join(upto, ["rank", "block"], "left"), "mx-placed")


def with_blocks(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` (source, key) with its source's columns and the row's block."""
    s = salted(sources.withColumnRenamed("source", "_mx_source"), name="_mx_salt")
    j = df.withColumn("_mx_s", salt_of("key")).join(
        s, F.col("source").eqNullSafe(F.col("_mx_source")) & (F.col("_mx_s") == F.col("_mx_salt")))
    return j.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("n_blocks")).cast("int")).drop("_mx_source", "_mx_s", "_mx_salt")


def allot(docs: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS, block_words: int = BLOCK_WORDS,
          shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, places) of every row; ``places``:
    array of (copy, shard), one for each time the document is taken."""
    plan = _plan(docs, share, most, weights, block_words, shard_words, seed)
    return _placed(plan.meta, plan).select("doc_id", "size", "source_size", "target", "places")


def _plan(docs: DataFrame, share, most, weights, block_words, shard_words, seed) -> Plan:
    ready(docs.sparkSession)
    meta = stored(docs.select("doc_id", "source", words("text").alias("size"), identity(seed).alias("key")), "mx-sizes")
    return Plan(meta, share, most, weights, block_words, shard_words, seed)


def _placed(rows: DataFrame, plan: Plan) -> DataFrame:
    j = rows.join(plan.blocks, ["rank", "block"], "left")
    beyond = F.col("cut_copy").isNotNull() & ~F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False))
    kept = F.expr("filter(places, x -> NOT (x.copy = cut_copy))")
    return j.withColumn("places", F.coalesce(F.when(beyond, kept).otherwise(F.col("places")), F.expr("filter(array(named_struct('copy', 0, 'shard', 0)), x -> false)")))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The taken copies with all columns of ``docs`` and ``copy`` (from 0),
    ``shard`` and ``place`` (a hash; rows of a shard come sorted by it). One of
    these that ``docs`` has itself stays as it is there, and the new one gets
    ``_mx_`` before its name."""
    plan = _plan(docs, share, most, weights, block_words, shard_words, seed)
    cols = [F.col(c).alias(f"_mx_{c}") for c in docs.columns if c not in ("doc_id", "source", "text")]
    rows = docs.select("doc_id", "source", "text", *cols, identity(seed).alias("key"))
    rows = _placed(with_blocks(rows, plan.sources.select("source", "rank", "n_blocks")), plan)
    own = [F.col(c if c in ("doc_id", "source", "text") else f"_mx_{c}").alias(c) for c in docs.columns]
    out = rows.select(*own, F.explode("places").alias("_mx_p"), F.col("key").alias("_mx_key"))
    copy, shard, place = (f"_mx_{c}" if c in docs.columns else c for c in ("copy", "shard", "place"))
    out = out.select(*docs.columns, F.col("_mx_p.copy").alias(copy), F.col("_mx_p.shard").alias(shard),
                     F.xxhash64(F.lit(seed), "_mx_key", "_mx_p.copy").alias(place))
    return out.repartition(shard).sortWithinPartitions(shard, place)
