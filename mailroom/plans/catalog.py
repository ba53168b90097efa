"""Registry of every query the engine answers: a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, the DuckDB
oracle text over the same base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN
from ..operators import dashboard as A
from ..operators import knowledge as KB
from ..operators import listing as L
from ..operators import similarity as S
from ..operators.page_rank import list_page_ranked
from ..operators.search_index import SearchIndex
from ..operators.substring_index import SubstringIndex
from ..session import scratch_path
from ..sources.fixtures import AS_OF, Fixtures, with_views
from .oracle_views import DERIVED, topk_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql.strip(), DERIVED)
        return fn
    return deco


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _fx(spark, sf_dir) -> Fixtures:
    return Fixtures(spark, sf_dir)


def _chunks(fx: Fixtures) -> DataFrame:
    return KB.chunk(fx.kb_sources)


LIST_FILTERS = dict(status="sent", urgency="high")
SEARCH = "the"
PAGE = 3

# ------------------------------------------------------------------ dashboard

register("total_emails", "SELECT count(*) AS total_emails FROM emails")(
    lambda spark, d: A.total_emails(_fx(spark, d).emails))
register("by_status", "SELECT status, count(*) AS c FROM emails GROUP BY status")(
    lambda spark, d: A.by_status(_fx(spark, d).emails))
register("auto_send_rate", """
SELECT count_if(auto_sent = 1) AS auto_sent,
 round(CAST(count_if(auto_sent = 1) AS DOUBLE) / greatest(count(*), 1) * 100.0, 1) AS auto_send_rate
FROM emails""")(lambda spark, d: A.auto_send_rate(_fx(spark, d).emails))
for _col, _key in (("department", "by_department"), ("sentiment", "by_sentiment"), ("urgency", "by_urgency")):
    register(_key, f"SELECT {_col}, count(*) AS c FROM emails WHERE {_col} IS NOT NULL GROUP BY {_col}")(
        (lambda c: lambda spark, d: A.count_by(_fx(spark, d).emails, c))(_col))
register("by_intent_top8", """
SELECT intent, count(*) AS c FROM emails WHERE intent IS NOT NULL GROUP BY intent
ORDER BY c DESC, intent ASC LIMIT 8""")(lambda spark, d: A.by_intent_top(_fx(spark, d).emails))
register("pending_count", "SELECT count_if(status = 'pending_approval') AS pending_approval FROM emails")(
    lambda spark, d: A.pending_count(_fx(spark, d).emails))
register("avg_confidence", """
SELECT round(coalesce(avg(CASE WHEN confidence_score > 0 THEN confidence_score END), 0.0) * 100.0, 1)
 AS avg_confidence FROM emails""")(lambda spark, d: A.avg_confidence(_fx(spark, d).emails))
register("daily_volume", f"""
SELECT CAST(received_at AS DATE) AS day, count(*) AS c FROM emails
WHERE received_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""")(
    lambda spark, d: A.daily_volume(_fx(spark, d).emails, AS_OF))
register("recent_window", f"""
SELECT id, received_at FROM emails WHERE received_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")(
    lambda spark, d: A.recent_window(_fx(spark, d).emails, AS_OF).select("id", "received_at"))
register("status_filters", """
SELECT count_if(auto_sent = 1) AS auto_sent, count_if(status = 'pending_approval') AS pending_approval,
 count_if(confidence_score > 0) AS scored, count(department) AS with_department, count(intent) AS with_intent,
 count(sentiment) AS with_sentiment, count(urgency) AS with_urgency FROM emails""")(
    lambda spark, d: A.status_filters(_fx(spark, d).emails))
register("kb_doc_count", "SELECT count(DISTINCT name) AS kb_documents FROM kb_chunks")(
    lambda spark, d: A.kb_doc_count(_chunks(_fx(spark, d))))


@register("recent_activity", """
SELECT a.id, a.email_id, a.action, a.actor, a.details, a.created_at, e.subject, e.sender_email
FROM (SELECT * FROM activity_log ORDER BY created_at DESC, id ASC LIMIT 10) a
LEFT JOIN emails e ON a.email_id = e.id""")
def _recent_activity(spark, d):
    fx = _fx(spark, d)
    r = A.recent_activity(fx.activity_log, fx.emails)
    return r.select("id", "email_id", "action", "actor", "details", ntz("created_at"), "subject", "sender_email")


@register("dashboard_stats", f"""
SELECT 'total_emails' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM emails
UNION ALL SELECT 'auto_sent', NULL, CAST(count_if(auto_sent = 1) AS DOUBLE) FROM emails
UNION ALL SELECT 'auto_send_rate', NULL,
 round(CAST(count_if(auto_sent = 1) AS DOUBLE) / greatest(count(*), 1) * 100.0, 1) FROM emails
UNION ALL SELECT 'pending_approval', NULL, CAST(count_if(status = 'pending_approval') AS DOUBLE) FROM emails
UNION ALL SELECT 'avg_confidence', NULL,
 round(coalesce(avg(CASE WHEN confidence_score > 0 THEN confidence_score END), 0.0) * 100.0, 1) FROM emails
UNION ALL SELECT 'by_status', status, CAST(count(*) AS DOUBLE) FROM emails GROUP BY status
UNION ALL SELECT 'by_department', department, CAST(count(*) AS DOUBLE) FROM emails
 WHERE department IS NOT NULL GROUP BY department
UNION ALL SELECT * FROM (SELECT 'by_intent', intent, CAST(count(*) AS DOUBLE) AS v FROM emails
 WHERE intent IS NOT NULL GROUP BY intent ORDER BY v DESC, intent ASC LIMIT 8)
UNION ALL SELECT 'by_sentiment', sentiment, CAST(count(*) AS DOUBLE) FROM emails
 WHERE sentiment IS NOT NULL GROUP BY sentiment
UNION ALL SELECT 'by_urgency', urgency, CAST(count(*) AS DOUBLE) FROM emails
 WHERE urgency IS NOT NULL GROUP BY urgency
UNION ALL SELECT 'daily_volume', CAST(CAST(received_at AS DATE) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM emails
 WHERE received_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 2
UNION ALL SELECT 'kb_documents', NULL, CAST(count(DISTINCT name) AS DOUBLE) FROM kb_chunks""")
def _dashboard_stats(spark, d):
    fx = _fx(spark, d)
    return A.dashboard_stats(fx.emails, _chunks(fx), AS_OF)


# ------------------------------------------------------------------ listing

_EMAIL_COLS = ("event_id, id, message_id, sender_name, sender_email, subject, text_body, html_body, "
               "received_at, status, department, intent, sentiment, urgency, confidence_score, ai_draft, auto_sent")

register("list_filter", f"SELECT {_EMAIL_COLS} FROM emails WHERE status = 'sent' AND urgency = 'high'")(
    lambda spark, d: L.list_filter(_fx(spark, d).emails, **LIST_FILTERS))
register("list_search", f"""
SELECT {_EMAIL_COLS} FROM emails
WHERE subject ILIKE '%{SEARCH}%' OR sender_email ILIKE '%{SEARCH}%' OR sender_name ILIKE '%{SEARCH}%'""")(
    lambda spark, d: L.list_filter(_fx(spark, d).emails, search=SEARCH))
@register("list_search_indexed", f"""
SELECT {_EMAIL_COLS} FROM emails
WHERE subject ILIKE '%{SEARCH}%' OR sender_email ILIKE '%{SEARCH}%' OR sender_name ILIKE '%{SEARCH}%'""")
def _list_search_indexed(spark, d):
    emails = _fx(spark, d).emails
    index = SubstringIndex(spark, scratch_path(spark, "substrings"))
    index.add(emails, 1)
    return index.search(emails, SEARCH).select(emails.columns)


register("list_page", f"""
SELECT {_EMAIL_COLS} FROM emails WHERE status = 'sent' AND urgency = 'high'
ORDER BY received_at DESC, id ASC LIMIT 20 OFFSET {(PAGE - 1) * 20}""")(
    lambda spark, d: L.list_page(_fx(spark, d).emails, page=PAGE, limit=20, **LIST_FILTERS))
register("list_page_ranked", f"""
SELECT {_EMAIL_COLS} FROM emails WHERE status = 'sent' AND urgency = 'high'
ORDER BY received_at DESC, id ASC LIMIT 20 OFFSET {(PAGE - 1) * 20}""")(
    lambda spark, d: list_page_ranked(_fx(spark, d).emails, page=PAGE, limit=20, **LIST_FILTERS))
register("list_total_pages", """
SELECT count(*) AS total, CAST((count(*) + 19) // 20 AS BIGINT) AS pages FROM emails
WHERE status = 'sent' AND urgency = 'high'""")(
    lambda spark, d: L.list_total_pages(_fx(spark, d).emails, limit=20, **LIST_FILTERS))
register("point_lookup", f"SELECT {_EMAIL_COLS} FROM emails WHERE id = 'm7'")(
    lambda spark, d: L.point_lookup(_fx(spark, d).emails, "m7"))


@register("email_detail", """
SELECT e.id, e.subject, e.sender_email, e.status, a.id AS act_id, a.action AS act_action,
 a.actor AS act_actor, a.details AS act_details, a.created_at AS act_created_at
FROM emails e LEFT JOIN activity_log a ON a.email_id = e.id""")
def _email_detail(spark, d):
    fx = _fx(spark, d)
    return L.email_detail(fx.emails, fx.activity_log)


@register("activity_sorted", """
SELECT id, email_id, action, actor, details, created_at FROM activity_log WHERE email_id = 'm7'""")
def _activity_sorted(spark, d):
    return L.activity_sorted(_fx(spark, d).activity_log, "m7").select(
        "id", "email_id", "action", "actor", "details", ntz("created_at"))


# ------------------------------------------------------------------ knowledge base

register("kb_chunk", "SELECT id, upload_id, name, chunk_index, content FROM kb_chunks")(
    lambda spark, d: _chunks(_fx(spark, d)).select("id", "upload_id", "name", "chunk_index", "content"))
register("chunks_per_upload", "SELECT upload_id, name, count(*) AS chunks FROM kb_chunks GROUP BY 1, 2")(
    lambda spark, d: KB.chunks_per_upload(_chunks(_fx(spark, d))))
register("kb_metadata", "SELECT id, name, file_type, department, created_at, chunk_index FROM kb_chunks")(
    lambda spark, d: KB.kb_metadata(_chunks(_fx(spark, d))).select(
        "id", "name", "file_type", "department", ntz("created_at"), "chunk_index"))


@register("kb_list", """
SELECT name, id, file_type, department, created_at, chunks FROM (
 SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, upload_id, chunk_index) AS rn,
  count(*) OVER (PARTITION BY name) AS chunks FROM kb_chunks) WHERE rn = 1""")
def _kb_list(spark, d):
    return KB.kb_list(_chunks(_fx(spark, d))).select(
        "name", "id", "file_type", "department", ntz("created_at"), "chunks")


@register("kb_delete", """
SELECT id, name, chunk_index FROM kb_chunks
WHERE name NOT IN (SELECT name FROM kb_chunks WHERE name LIKE 'src1/%')""")
def _kb_delete(spark, d):
    ch = _chunks(_fx(spark, d))
    dels = ch.filter(F.col("name").like("src1/%")).select("name")
    return KB.kb_delete(ch, dels).select("id", "name", "chunk_index")


register("tokenize", f"""
SELECT upload_id, chunk_index, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT upload_id, chunk_index, regexp_extract_all(lower(content), '{TOKEN_PATTERN}') AS t FROM kb_chunks)
""")(
    lambda spark, d: KB.tokenize(_chunks(_fx(spark, d)), KB.CHUNK_KEY))
register("term_freq", """
SELECT p.upload_id, p.chunk_index, p.tok, p.n, p.n / sum(p.n) OVER (PARTITION BY p.upload_id, p.chunk_index) AS tf
FROM kb_postings p""")(lambda spark, d: KB.term_freq(_chunks(_fx(spark, d)), KB.CHUNK_KEY))
register("kb_index", "SELECT upload_id, chunk_index, tok, n, n2 FROM kb_postings")(
    lambda spark, d: KB.kb_index(_chunks(_fx(spark, d))))

# ------------------------------------------------------------------ similarity

# T3 over candidates: the best items of every query
_BEST = topk_sql("query_terms", "bench_terms", "q_id", ["item_id"])


@register("cosine_pairs", f"""
SELECT h.q_id, h.item_id, CAST(sum(q.n * d.n) AS BIGINT) AS dot,
 sum(q.n * d.n) / (sqrt(any_value(q.n2)) * sqrt(any_value(d.n2))) AS score
FROM ({_BEST}) h JOIN query_terms q ON q.q_id = h.q_id JOIN bench_terms d ON d.item_id = h.item_id AND d.tok = q.tok
GROUP BY h.q_id, h.item_id""")
def _cosine_pairs(spark, d):
    q = KB.term_vectors(_fx(spark, d).kb_queries, ["q_id"], "text")
    items = KB.term_vectors(_fx(spark, d).benchmark, ["item_id"], "text")
    best = S.search(_fx(spark, d).kb_queries, items, ["q_id"], ["item_id"])
    return S.cosine_scores(best, q, items, ["q_id"], ["item_id"])


register("kb_topk", topk_sql("query_terms", "kb_postings", "q_id", ["upload_id", "chunk_index"]))(
    lambda spark, d: S.search(_fx(spark, d).kb_queries, KB.kb_index(_chunks(_fx(spark, d))), ["q_id"]))
register("benchmark_topk", topk_sql("query_terms", "bench_terms", "q_id", ["item_id"]))(
    lambda spark, d: S.search(_fx(spark, d).kb_queries,
                              KB.term_vectors(_fx(spark, d).benchmark, ["item_id"], "text"),
                              ["q_id"], ["item_id"]))


@register("kb_live_topk", topk_sql("query_terms", "(SELECT * FROM kb_postings WHERE upload_id % 5 <> 1)", "q_id",
                                   ["upload_id", "chunk_index"]))
def _kb_live_topk(spark, d):
    """Hits from a kept index: uploads arrive in three batches, every fifth is
    removed in the last, and the index is compacted before that."""
    chunks = _chunks(_fx(spark, d))
    index = SearchIndex(spark, scratch_path(spark, "kb-index"))
    for batch in (1, 2, 3):
        index.add(KB.kb_index(chunks.where(F.col("upload_id") % 3 == batch - 1)), batch)
        if batch == 2:
            index.compact()
    index.delete(chunks.where("upload_id % 5 = 1").select("upload_id"), 4)
    return S.search(_fx(spark, d).kb_queries, index, ["q_id"])


@register("kb_context", """
SELECT CASE WHEN count(*) > 0 THEN string_agg(b, chr(10) || chr(10) ORDER BY created_at, name, chunk_index, id)
 ELSE 'No company knowledge base documents uploaded yet.' END AS kb_context
FROM (SELECT created_at, name, chunk_index, id, '[' || name || ']: ' || substring(content, 1, 800) AS b
      FROM kb_chunks ORDER BY created_at, name, chunk_index, id LIMIT 20)""")
def _kb_context(spark, d):
    return S.kb_context(_chunks(_fx(spark, d)))
FLAGSHIP = "triage"
from . import catalog_flow  # noqa: E402,F401  (registers the flow keys)
from . import catalog_stream  # noqa: E402,F401  (registers the streaming keys)
