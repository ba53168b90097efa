"""Token-frequency cosine similarity and per-query top-k (T3-T7).

Score of query q and document d over shared tokens t, with integer term
counts (the 1/length factors of term frequency cancel in the cosine):

    score = sum_t qn(t) * dn(t) / (sqrt(sum qn^2) * sqrt(sum dn^2))

Pairs that share no token score 0 and are never made. Stop-words are kept and
there is no idf, so pairs that share some token are nearly all pairs; they
are scored inside tasks over blocks of documents whose upper bounds reach a
query's floor (``search``, see topk_kernel), and only a query's best leave them.
``cosine_scores`` scores given pairs. ``SearchIndex`` (search_index) keeps the
blocks of a growing table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import fanout_partitions
from .knowledge import CHUNK_KEY, term_vectors
from .search_index import SearchIndex
from .topk_kernel import bounded_topk, sharded_topk

TOP_K = 3                 # fixed: passages per message
CONTEXT_CHARS = 500       # fixed: characters of a passage kept as context
FALLBACK_CHARS = 2000     # fixed: characters of the KB context used without hits
KB_CONTEXT_ROWS = 20      # fixed: chunk rows in the KB context
KB_CONTEXT_CHUNK_CHARS = 800  # fixed: characters per chunk in the KB context
NO_KB_TEXT = "No company knowledge base documents uploaded yet."  # fixed text


def cosine_scores(candidates: DataFrame, qterms: DataFrame, dterms: DataFrame, qkeys: list[str],
                  dkeys: list[str]) -> DataFrame:
    """(qkeys, dkeys, dot, score) of the given (qkeys, dkeys) pairs that share a
    token. Each pair brings its query's terms to its document's: the rows are
    bounded by the candidates and the lengths of their queries."""
    q = qterms.select(*qkeys, "tok", F.col("n").alias("_qn"), F.col("n2").alias("_q2"))
    d = dterms.select(*dkeys, "tok", F.col("n").alias("_dn"), F.col("n2").alias("_d2"))
    both = candidates.select(*qkeys, *dkeys).distinct().join(q, qkeys).join(d, [*dkeys, "tok"])
    agg = both.groupBy(*qkeys, *dkeys).agg(F.sum(F.col("_qn") * F.col("_dn")).alias("dot"),
                                           F.first("_q2").alias("_q2"), F.first("_d2").alias("_d2"))
    score = F.col("dot") / (F.sqrt(F.col("_q2").cast("double")) * F.sqrt(F.col("_d2").cast("double")))
    return agg.select(*qkeys, *dkeys, "dot", score.alias("score"))


def search(queries: DataFrame, index: DataFrame | SearchIndex, qkeys: list[str], dkeys: list[str] = CHUNK_KEY,
           text: str = "text", k: int = TOP_K, shards: int | None = None, blocks: int | None = None) -> DataFrame:
    """queries(qkeys, text) x index -> top-k hits (qkeys, rank, dkeys, score):
    score desc, ties to the later-added document (larger key), only scores above
    0. Rank starts at 1.

    ``index``: a kept ``SearchIndex``, or terms (dkeys, tok, n, n2), which are
    laid out in ``shards`` for this search alone. Queries are dealt into
    ``blocks`` lots. Both numbers follow the input's bytes if not given."""
    parted = queries.select(*qkeys, text).repartition(fanout_partitions(queries), *qkeys)
    qterms = term_vectors(parted, qkeys, text)
    if isinstance(index, SearchIndex):
        hits = bounded_topk(qterms, index.documents(), index.leading(), index.bundles(), qkeys, index.keys, k, blocks)
        return hits.select(*qkeys, "rank", *index.keys, "score")
    return sharded_topk(qterms, index, qkeys, dkeys, k, shards, blocks).select(*qkeys, "rank", *dkeys, "score")


def with_chunk_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach name and the passage text to each hit (<= k per query).

    A plain equi-join: AQE measures the hits once they are materialised and
    broadcasts them when small (a measured bound, not a guess); otherwise
    both sides shuffle by chunk key. Only the first 500 characters of a
    chunk travel."""
    c = chunks.select(*CHUNK_KEY, "name", F.substring("content", 1, CONTEXT_CHARS).alias("passage"))
    return hits.join(c, CHUNK_KEY, "left")


def search_query(subject, intent, topics) -> F.Column:
    """Query text: subject, intent and topics joined by single spaces
    (a missing intent renders as ``None``)."""
    return F.concat_ws(" ", F.coalesce(subject, F.lit("")), search_tail(intent, topics))


def search_tail(intent, topics) -> F.Column:
    """What follows the subject in a query text: it comes from the response."""
    return F.concat_ws(" ", F.coalesce(intent, F.lit("None")),
                       F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "))


def rag_context(hits_with_text: DataFrame, qkeys: list[str]) -> DataFrame:
    """Per query: ``Source: name\\npassage`` blocks in rank order joined by a
    blank line. Groups hold <= k rows, so the collect is bounded."""
    block = F.concat(F.lit("Source: "), F.coalesce(F.col("name"), F.lit("doc")), F.lit("\n"),
                     F.coalesce(F.col("passage"), F.lit("")))
    return (hits_with_text.groupBy(*qkeys)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))),
                                          lambda x: x["b"]), "\n\n").alias("rag_context"),
                 F.count(F.lit(1)).alias("n_hits")))


def kb_context(chunks: DataFrame, rows: int = KB_CONTEXT_ROWS) -> DataFrame:
    """One row: the first ``rows`` chunks (created_at, name, chunk_index, id)
    as ``[name]: content`` joined by a blank line, or a fixed sentence when
    the knowledge base is empty. Top-n sort, then a bounded collect."""
    first = (chunks.orderBy("created_at", "name", "chunk_index", "id").limit(rows)
             .select("created_at", "name", "chunk_index", "id",
                     F.concat(F.lit("["), F.col("name"), F.lit("]: "),
                              F.substring("content", 1, KB_CONTEXT_CHUNK_CHARS)).alias("b")))
    agg = first.agg(F.count(F.lit(1)).alias("n"),
                    F.array_join(F.transform(F.array_sort(F.collect_list(
                        F.struct("created_at", "name", "chunk_index", "id", "b"))), lambda x: x["b"]),
                        "\n\n").alias("txt"))
    return agg.select(F.when(F.col("n") > 0, F.col("txt")).otherwise(F.lit(NO_KB_TEXT)).alias("kb_context"))
