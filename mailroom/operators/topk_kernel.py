"""Per-query top-k over blocks of documents with upper bounds.

A document's weights are its counts over its norm. Documents with the same
heaviest token and similar norms are laid side by side and cut into *blocks* of
``BLOCK``; a block has an upper bound for each of its tokens, the largest weight.
A query's score in a block is at most the sum of its own counts times these
bounds, over its norm. The k-th score in its most promising block is a *floor*
under its result, and blocks whose bound stays below the floor hold no hit.

``sharded_topk`` searches terms that are given for this search. Documents go to
shards and queries into lots, both as compressed bundles; every (shard, lot) is one
task (``cogroup``), which opens some thousand documents at a time, lays them out in
blocks, bounds its queries' scores in each, scores the most promising block and then
those whose bound reaches the floor. Floors rise from one lot of documents to the
next. A task's memory follows the compressed bytes of a shard and what is open, not
the table. Planning it runs no job.

``bounded_topk`` searches blocks that were written before, with their bounds
(``search_index``), and writes nothing for a pair of a query and a block:

  1. every token has a *leading* block, where its weight is largest by the written
     bounds. A query's most promising block is that of the largest bound from the
     tokens it leads (a join on tokens: one row for each term of a query);
  2. a first pass scores each query in that block, for its floor: a cogroup by
     block, where documents and queries move once. Beyond one lot of queries, a
     block goes to the lots that want it and no others;
  3. a second pass meets compressed bundles of all live documents with bundles of
     all queries and their floors, both written once (those of the documents serve
     until the index changes), in a plain cross join: no
     shuffle, so disk grows with the two tables and not with their product. A task
     lays the documents of a bundle out in blocks, bounds its queries' scores in
     each, scores the blocks whose bound reaches the floor, and gives out the hits
     that do.

What several steps read (queries' terms, bundles) is written to the shared folder
when the search is set up, so a lost executor costs no earlier step.

In a block the tokens that many of its documents hold are columns of a dense matrix,
and one matrix product scores thousands of pairs; other tokens are added one by one.
Scores are integer products, summed exactly, and divided by the norms in the
same order as the SQL form. Nothing passes through the driver. One document is never split, whatever its number of tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.sizing import fanout_partitions, input_bytes
from ..session import written

# Documents of one block.
BLOCK = 256
# Bytes of query text (as scanned) for one lot of queries, and of documents for one
# shard: a task holds both compressed, and opens a bundle at a time.
LOT_BYTES = 192 << 20
SHARD_BYTES = 256 << 20
# A bound counts as reached from this much below: more than doubles lose in a sum.
SLACK = 1 - 1e-9
# Documents of one block that a task lays out for itself.
LAID = 1024
# A token that so large a share of a block's documents hold is a column of its matrix.
DENSE = 0.2
# Documents that a task lays out at a time.
_DOCUMENTS = 5_000
# A token that so large a share of the documents hold may tell where they lie.
COMMON = 0.05
# Entries of postings that a task adds up at a time, and pairs that it scores.
_ENTRIES = 4_000_000
_PAIRS = 1 << 20
# Whole numbers below are exact in single precision; a share that its divisions may lose.
_EXACT = 1 << 24
_ROUNDED = 1e-6
_TINY = 1e-30


class Postings:
    """The documents of a task by token and block. Documents are numbered in
    ascending key order, so the larger number is the larger key. A *run* is the
    postings of one token in one block: ``place[at[r]:at[r + 1]]`` (places in the
    block) and their counts. In each block the tokens of many documents are the
    columns of a dense matrix, and the others stay runs. For bounds, token ``t`` has
    ``block`` and ``most`` from ``start[t]`` to ``start[t + 1]``."""

    def __init__(self, t: pa.Table, dkeys: list[str], block: int = LAID):
        t = t.sort_by([(c, "ascending") for c in dkeys])
        tokens = _chunk(t.column("toks"))
        self.keys = [_chunk(t.column(c)) for c in dkeys]
        self.norm = np.sqrt(t.column("n2").to_numpy().astype(np.float64))
        words = tokens.flatten().dictionary_encode()
        self.vocabulary = words.dictionary
        code = words.indices.to_numpy()
        count = _chunk(t.column("ns")).flatten().to_numpy().astype(np.float64)
        size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        # documents by heaviest token (one that many hold, if they have any), then by norm
        held = np.bincount(code, minlength=len(self.vocabulary))
        heaviest = np.lexsort((code, -count, held[code] < COMMON * len(size), doc))[np.concatenate([[0], np.cumsum(size)[:-1]])] if len(doc) else doc
        self.side = np.lexsort((self.norm, code[heaviest]))
        spot = np.empty(len(self.side), np.int64)
        spot[self.side] = np.arange(len(self.side))
        self.blocks, self.size = -(-len(self.side) // block), block
        of = spot // block
        order = np.lexsort((spot[doc], code, of[doc]))
        code, doc, count = code[order], doc[order], count[order]
        of, self.place = of[doc], (spot[doc] % block).astype(np.int32)
        begins = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
        self.at = np.concatenate([begins, [len(code)]])
        self._lay_out(code[begins], of[begins], count)
        by = np.argsort(code[begins], kind="stable")  # bounds are looked up by token
        self.block, self.most = of[begins][by], np.maximum.reduceat(count / self.norm[doc], begins)[by]
        self.start = np.searchsorted(code[begins][by], np.arange(len(self.vocabulary) + 1))
        self.scored = self.bounded = 0  # (query, block) pairs scored, and bounded

    def _lay_out(self, token: np.ndarray, block: np.ndarray, count: np.ndarray) -> None:
        """For each block its dense matrix, and for each token the column or the run
        that it has there, or -1."""
        held = np.diff(self.at)
        self.count = count.astype(np.float32 if self.norm.max(initial=1) < _EXACT else np.float64)
        self.dense, self.column, self.run = [], [], []
        for b, (begin, end) in enumerate(np.searchsorted(block, [[b, b + 1] for b in range(self.blocks)])):
            docs = min(self.size, len(self.norm) - b * self.size)
            many = held[begin:end] >= DENSE * docs
            wide, few = np.flatnonzero(many) + begin, np.flatnonzero(~many) + begin
            column, run = np.full(len(self.vocabulary), -1, np.int32), np.full(len(self.vocabulary), -1, np.int32)
            column[token[wide]], run[token[few]] = np.arange(len(wide)), few
            matrix = np.zeros((len(wide), docs), self.count.dtype)
            at = _ranges(self.at[wide], held[wide])
            matrix[np.repeat(np.arange(len(wide)), held[wide]), self.place[at]] = self.count[at]
            self.dense.append(matrix)
            self.column.append(column)
            self.run.append(run)

    def best(self, q: np.ndarray, code: np.ndarray, n: np.ndarray, norm: np.ndarray, k: int,
             known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(query, document, score) of the best ``k`` of each query. ``q``
        (ascending), ``code`` and ``n``: its terms' query, token and count.
        ``known``: floors of the queries; lower scores are not wanted."""
        first, queries = q[0], q[-1] - q[0] + 1
        norm = norm[first:first + queries]
        known = np.zeros(queries) if known is None else known[first:first + queries] * SLACK
        q = q - first
        if len(q) > 1 and not (np.diff(q * len(self.vocabulary) + code) > 0).all():  # by token, each once
            each, at = np.unique(q * len(self.vocabulary) + code, return_inverse=True)
            q, code, n = each // len(self.vocabulary), each % len(self.vocabulary), np.bincount(at, weights=n)
        size = self.start[code + 1] - self.start[code]
        run = _ranges(self.start[code], size)
        bound = np.bincount(np.repeat(q, size) * self.blocks + self.block[run], weights=np.repeat(n, size) * self.most[run],
                            minlength=queries * self.blocks).reshape(queries, -1) / norm[:, None]
        terms = np.searchsorted(q, np.arange(queries + 1)), code, n
        here = np.zeros(bound.shape, bool)
        here[np.arange(queries), bound.argmax(1)] = bound.max(1) >= known
        here &= bound > 0
        floor = known.copy()
        found = [self._scored(b, here[:, b], terms, norm, floor, k) for b in range(self.blocks)]
        if self.blocks > 1:
            rest = ~here & (bound >= np.maximum(floor * SLACK, known)[:, None]) & (bound > 0)
            found += [self._scored(b, rest[:, b], terms, norm, floor, k) for b in range(self.blocks)]
            here |= rest
        self.scored += int(here.sum())
        self.bounded += int((bound > 0).sum())
        row, doc, s = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = s >= known[row]
        row, doc, s = _cut(row[keep], doc[keep], s[keep], k)
        return row + first, doc, s

    def _scored(self, b: int, wanted: np.ndarray, terms: tuple[np.ndarray, ...], norm: np.ndarray, floor: np.ndarray,
                k: int) -> tuple[np.ndarray, ...]:
        """(query, document, score) of the best ``k`` of the wanted queries in a
        block that reach their floors, which rise to the k-th score there."""
        which = np.flatnonzero(wanted)
        begin, code, n = terms
        docs = self.side[b * self.size:b * self.size + self.dense[b].shape[1]]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        each = max(1, _PAIRS // max(len(docs), len(self.dense[b])))
        back = 1 / self.norm[docs]
        for some in (which[i:i + each] for i in range(0, len(which), each)):
            size = begin[some + 1] - begin[some]
            term = _ranges(begin[some], size)
            of, t, w = np.repeat(np.arange(len(some)), size), code[term], n[term]
            dot = self._dots(b, of, t, w, norm[some])
            score = dot * back.astype(dot.dtype)  # times the query's norm
            least = floor[some] * norm[some]
            reach = score >= np.maximum(least * (1 - _ROUNDED), _TINY).astype(score.dtype)[:, None]
            many = np.flatnonzero(np.count_nonzero(reach, 1) > 2 * k)
            if len(many):
                least[many] = np.maximum(least[many], np.partition(score[many], len(docs) - k, 1)[:, -k])
                floor[some[many]] = least[many] * (1 - _ROUNDED) / norm[some[many]]
                reach[many] = score[many] >= np.maximum(least[many] * (1 - _ROUNDED), _TINY).astype(score.dtype)[:, None]
            row, at = np.divmod(np.flatnonzero(reach), len(docs))
            s = dot[row, at].astype(np.float64) / (norm[some][row] * self.norm[docs[at]])
            row, doc, s = _cut(row, docs[at], s, k)
            found.append((some[row], doc, s))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _dots(self, b: int, of: np.ndarray, code: np.ndarray, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(queries, documents of the block): exact products. They are whole numbers,
        none above the product of the two norms, which in single precision is below 2^24."""
        matrix = self.dense[b]
        if matrix.dtype == np.float32 and norm.max() * self.norm.max() >= _EXACT:
            matrix = matrix.astype(np.float64)
        column, run = self.column[b][code], self.run[b][code]
        asked = np.zeros((len(norm), len(matrix)), matrix.dtype)
        use = column >= 0
        asked[of[use], column[use]] = n[use]
        dot = asked @ matrix
        use = run >= 0
        of, run, n = of[use] * dot.shape[1], run[use], n[use].astype(dot.dtype)
        size = self.at[run + 1] - self.at[run]
        ends = np.cumsum(size)
        begin = 0
        while begin < len(run):  # some millions of postings at a time
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _ENTRIES)))
            at = _ranges(self.at[run[begin:end]], size[begin:end])
            to = np.repeat(of[begin:end], size[begin:end])
            to += self.place[at]
            add = np.repeat(n[begin:end], size[begin:end])
            add *= self.count[at]
            np.add.at(dot.reshape(-1), to, add)
            begin = end
        return dot


def _cut(row: np.ndarray, doc: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` of each row, ties to the larger document."""
    order = np.lexsort((-doc, -s, row))
    row, doc, s = row[order], doc[order], s[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], doc[keep], s[keep]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _chunk(c: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)


def packed(terms: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its tokens, their counts and the squared norm.
    Terms are partitioned by key, so this adds no exchange; the arrays are no
    longer than the text."""
    return terms.groupBy(*keys).agg(F.collect_list("tok").alias("toks"), F.collect_list("n").alias("ns"), F.max("n2").alias("n2"))


def bundled(queries: DataFrame, qkeys: list[str]) -> DataFrame:
    """Packed queries as compressed bundles (words, rows): the distinct tokens of
    some thousand queries, and the queries with numbers for their tokens. A query
    goes to every shard, so its bytes count as often. (Documents go the same way.)"""
    kept = [*qkeys, "n2", *[c for c in queries.columns if c == "floor"]]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            toks = b.column("toks")
            words = toks.flatten().dictionary_encode()
            size = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            rows = pa.table({**{c: b.column(c) for c in kept}, "ns": b.column("ns"), "toks": pa.ListArray.from_arrays(at, words.indices)})
            yield pa.RecordBatch.from_pydict({"words": pa.array([_bytes(pa.table({"w": words.dictionary}))], pa.binary()),
                                              "rows": pa.array([_bytes(rows)], pa.binary())})

    return queries.select(*kept, "ns", "toks").mapInArrow(run, "words binary, rows binary")


def _bytes(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _opened(bundles: pa.Table):
    """(table of packed rows without tokens, the distinct tokens, the rows' lists of
    numbers for them) of each bundle, one at a time."""
    for words, rows in zip(bundles.column("words"), bundles.column("rows"), strict=True):
        w, t = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (words, rows))
        yield t.drop_columns("toks"), _chunk(w.column("w")), _chunk(t.column("toks"))


def _unbundled(bundles: pa.Table):
    """The tables of packed rows that bundles hold, one at a time."""
    for t, words, codes in _opened(bundles):
        yield t.append_column("toks", pa.ListArray.from_arrays(codes.offsets, words.take(codes.values)))


def _laid_out(bundles: pa.Table, dkeys: list[str]):
    """Postings of the documents that bundles hold, of some thousand documents each."""
    held: list[pa.Table] = []
    for t in _unbundled(bundles):
        for at in range(0, t.num_rows, _DOCUMENTS):
            part = t.slice(at, _DOCUMENTS).combine_chunks()
            if held and sum(h.num_rows for h in held) + part.num_rows > _DOCUMENTS:
                yield Postings(pa.concat_tables(held), dkeys)
                held = []
            held.append(part)
    if held:
        yield Postings(pa.concat_tables(held), dkeys)


def _scored(qkeys: list[str], k: int, schema: pa.Schema):
    """``best`` (queries, k): the best scores of these queries so far, which others
    have to reach; they are brought up to date."""

    def scored(p: Postings, queries: pa.Table, words: pa.Array, toks: pa.Array, best: np.ndarray | None = None) -> pa.Table:
        code = pc.index_in(words, value_set=p.vocabulary).fill_null(-1).to_numpy()[toks.flatten().to_numpy()]
        known = code >= 0
        size = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
        q = np.repeat(np.arange(len(size)), size)[known]
        code = code[known]
        count = _chunk(queries.column("ns")).flatten().to_numpy().astype(np.float64)[known]
        norm = np.sqrt(queries.column("n2").to_numpy().astype(np.float64))
        floor = queries.column("floor").to_numpy() if "floor" in queries.column_names else None
        if best is not None:
            floor = best.min(1) if floor is None else np.maximum(floor, best.min(1))
        # as many queries at a time as their terms' runs and their bounds allow
        runs = np.cumsum(p.start[code + 1] - p.start[code])
        found, at = [], 0
        while at < len(q):
            before = runs[at - 1] if at else 0
            end = np.searchsorted(runs, before + _ENTRIES, "right")
            end = min(end, np.searchsorted(q, q[at] + max(1, _ENTRIES // p.blocks), "left"))
            if end < len(q):  # whole queries, one at least
                end = max(np.searchsorted(q, q[end], "left"), np.searchsorted(q, q[at], "right"))
            found.append(p.best(q[at:end], code[at:end], count[at:end], norm, k, floor))
            at = end
        if not found:
            return schema.empty_table()
        row, hit, score = (np.concatenate(c) for c in zip(*found, strict=True))
        if best is not None:
            now = np.zeros((len(best), 2 * k))
            now[:, :k] = best
            now[row, k + np.arange(len(row)) - np.searchsorted(row, row)] = score
            best[:] = np.partition(now, k, 1)[:, k:]
        row, hit = pa.array(row), pa.array(hit)
        cols = [_chunk(queries.column(c)).take(row) for c in qkeys] + [c.take(hit) for c in p.keys]
        return pa.Table.from_arrays([*cols, pa.array(score)], names=schema.names).cast(schema)

    return scored


def _plain(queries: pa.Table) -> tuple[pa.Table, pa.Array, pa.Array]:
    """Packed rows as ``_opened`` gives them."""
    toks = _chunk(queries.column("toks"))
    words = toks.flatten().dictionary_encode()
    size = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
    at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return queries, words.dictionary, pa.ListArray.from_arrays(at, words.indices)


def _scorer(qkeys: list[str], dkeys: list[str], k: int, schema: pa.Schema):
    scored = _scored(qkeys, k, schema)

    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        if "words" not in docs.column_names:
            return scored(Postings(docs, dkeys), *_plain(queries))
        found, best = [], {}
        for p in _laid_out(docs, dkeys):
            for i, (q, words, toks) in enumerate(_opened(queries)):
                found.append(scored(p, q, words, toks, best.setdefault(i, np.zeros((q.num_rows, k)))))
        return pa.concat_tables(found)

    return run


def _hit(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("score", T.DoubleType())])


def _cogrouped(docs: DataFrame, queries: DataFrame, groups: list[str], tasks: int, qfields: list[T.StructField], dfields: list[T.StructField], k: int) -> DataFrame:
    qkeys, dkeys = [f.name for f in qfields], [f.name for f in dfields]
    out = _hit([*qfields, *dfields])
    met = docs.repartition(tasks, *groups).groupBy(*groups).cogroup(queries.repartition(tasks, *groups).groupBy(*groups))
    return met.applyInArrow(_scorer(qkeys, dkeys, k, to_arrow_schema(out)), out)


def _ranked(hits: DataFrame, qkeys: list[str], dkeys: list[str], k: int) -> DataFrame:
    # at most k rows of a query from each group that it was scored in
    w = Window.partitionBy(*qkeys).orderBy(F.col("score").desc(), *[F.col(c).desc() for c in dkeys])
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sharded_topk(qterms: DataFrame, dterms: DataFrame, qkeys: list[str], dkeys: list[str], k: int,
                 shards: int | None = None, lots: int | None = None) -> DataFrame:
    """Top-k hits (qkeys, rank, dkeys, score) of query terms against document
    terms, each (keys, tok, n, n2) and partitioned by its keys."""
    shards = shards or fanout_partitions(dterms, SHARD_BYTES)
    lots = lots or max(1, math.ceil(input_bytes(qterms) / LOT_BYTES))
    part = F.spark_partition_id()  # both are partitioned by key, so a bundle's rows belong to its partition
    lot = F.pmod(part, F.lit(lots)).cast("int").alias("_lot")
    held, asked = packed(dterms, dkeys), packed(qterms, qkeys)
    docs = bundled(held, dkeys).select("*", F.pmod(part, F.lit(shards)).cast("int").alias("_shard"))
    docs = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"))
    queries = bundled(asked, qkeys).select("*", lot).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    qfields, dfields = [asked.schema[c] for c in qkeys], [held.schema[c] for c in dkeys]
    return _ranked(_cogrouped(docs, queries, ["_shard", "_lot"], shards * lots, qfields, dfields, k), qkeys, dkeys, k)


def arranged(docs: DataFrame, dkeys: list[str], shards: int) -> DataFrame:
    """Packed documents (dkeys, toks, ns, n2) with their ``block``. The order is
    cut anew whenever it is computed, so write it before it is read twice."""
    order = ["_top", "n2", *dkeys]
    heavy = F.array_max(F.arrays_zip("ns", "toks"))["toks"]
    laid = docs.withColumn("_top", heavy).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's below
    laid = laid.withColumn("_at", at)
    number = F.col("_at").bitwiseAND(2 ** 33 - 1)
    block = F.shiftright("_at", 33) * F.lit(2 ** 33 // BLOCK) + F.floor(number / BLOCK)
    return laid.withColumn("block", block).drop("_top", "_at")


def token_bounds(docs: DataFrame) -> DataFrame:
    """(block, tok, most): the largest weight of a token in a block."""
    each = docs.select("block", "n2", F.explode(F.arrays_zip("toks", "ns")).alias("t"))
    weight = F.col("t.ns") / F.sqrt(F.col("n2").cast("double"))
    return each.groupBy("block", F.col("t.toks").alias("tok")).agg(F.max(weight).alias("most"))


def query_bounds(queries: DataFrame, bounds: DataFrame, qkeys: list[str]) -> DataFrame:
    """(qkeys, block, bound): no document of the block scores higher."""
    terms = queries.select(*qkeys, "n2", F.explode(F.arrays_zip("toks", "ns")).alias("t"))
    share = F.col("t.ns") / F.sqrt(F.col("n2").cast("double"))
    terms = terms.select(*qkeys, F.col("t.toks").alias("tok"), share.alias("share"))
    met = terms.join(bounds.hint("merge"), "tok")
    return met.groupBy(*qkeys, "block").agg(F.sum(F.col("share") * F.col("most")).alias("bound"))


def first_blocks(reach: DataFrame, qkeys: list[str]) -> DataFrame:
    """(qkeys, block): the most promising block of each query."""
    return reach.groupBy(*qkeys).agg(F.max_by("block", F.struct("bound", "block")).alias("block"))


def leading_blocks(bounds: DataFrame) -> DataFrame:
    """(block, tok, most): of each token only the block where it weighs most."""
    return bounds.groupBy("tok").agg(F.max(F.struct("most", "block")).alias("b")).select("b.block", "tok", "b.most")


def score_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, qkeys: list[str], dkeys: list[str], k: int,
                lots: int, tasks: int) -> DataFrame:
    """(qkeys, dkeys, score): each query's best ``k`` in each of its blocks."""
    lot = F.pmod(F.xxhash64(*qkeys), F.lit(lots)).cast("int").alias("lot")
    asked = pairs.join(queries.hint("merge"), qkeys).select("*", lot)
    if lots > 1:
        held = docs.join(pairs.select("block", lot).distinct().hint("merge"), "block")
    else:
        held = docs.withColumn("lot", F.lit(0))
    return _cogrouped(held, asked, ["block", "lot"], tasks, [queries.schema[c] for c in qkeys], [docs.schema[c] for c in dkeys], k)


def score_bundles(queries: DataFrame, docs: DataFrame, qfields: list[T.StructField], dfields: list[T.StructField], k: int) -> DataFrame:
    """(qkeys, dkeys, score): each query's best ``k`` in each bundle of documents,
    none below its floor. Both sides are bundles in files; none is shuffled."""
    qkeys, dkeys = [f.name for f in qfields], [f.name for f in dfields]
    out = _hit([*qfields, *dfields])
    schema = to_arrow_schema(out)
    scored = _scored(qkeys, k, schema)

    def run(batches):
        held, laid, best = None, [], {}
        for b in batches:
            for i in range(b.num_rows):
                one = pa.Table.from_batches([b.slice(i, 1)])
                if held is None or not held.equals(one.column("doc_rows")):  # a bundle's rows come one after another
                    held, of = one.column("doc_rows"), one.select(["doc_words", "doc_rows"]).rename_columns(["words", "rows"])
                    laid = list(_laid_out(of, dkeys))
                (q, words, toks), name = next(_opened(one)), one.column("id")[0].as_py()
                for p in laid:
                    yield from scored(p, q, words, toks, best.setdefault(name, np.zeros((q.num_rows, k)))).to_batches()

    pairs = docs.select(F.col("words").alias("doc_words"), F.col("rows").alias("doc_rows")).crossJoin(queries.withColumn("id", F.xxhash64("words", "rows")))
    return pairs.mapInArrow(run, out)


def bounded_topk(qterms: DataFrame, docs: DataFrame, leading: DataFrame, held: DataFrame, qkeys: list[str], dkeys: list[str], k: int,
                 lots: int | None = None, tasks: int | None = None) -> DataFrame:
    """Top-k hits (qkeys, rank, dkeys, score) of query terms (qkeys, tok, n, n2;
    partitioned by their keys) against written blocks of documents, the bounds of
    their tokens' leading blocks, and the same documents in written bundles
    (``held``). A query without a key has no hits."""
    lots = lots or max(1, math.ceil(input_bytes(qterms) / LOT_BYTES))
    tasks = tasks or fanout_partitions(docs)
    queries = written(packed(qterms, qkeys).dropna(subset=qkeys), "search-queries")
    first = first_blocks(query_bounds(queries, leading, qkeys), qkeys)
    here = score_pairs(first, queries, docs, qkeys, dkeys, k, lots, tasks)
    floor = here.groupBy(*qkeys).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = queries.join(floor.hint("merge"), qkeys, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    asked = written(bundled(known, qkeys).coalesce(lots), "search-asked")
    hits = score_bundles(asked, held, [queries.schema[c] for c in qkeys], [docs.schema[c] for c in dkeys], k)
    return _ranked(hits, qkeys, dkeys, k)
