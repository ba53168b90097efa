"""Independent SQL definitions of derived tables, used only by the DuckDB
oracle (the Spark side builds the same tables with the DataFrame API)."""

from __future__ import annotations

from ..functions.text import TOKEN_PATTERN, WS_RUN

DERIVED: dict[str, str] = {}

def chunk_sql(src: str) -> str:
    """Chunk rows of a source view (upload_id, name, file_type, department,
    content, created_at): 800-word windows every 750 words."""
    return f"""
SELECT CAST(s.upload_id AS VARCHAR) || '-' || CAST(g.i // 750 AS VARCHAR) AS id, s.upload_id, s.name,
 s.file_type, array_to_string(list_slice(s.w, g.i + 1, g.i + 800), ' ') AS content,
 CAST(g.i // 750 AS INTEGER) AS chunk_index, s.department, s.created_at
FROM (SELECT *, list_filter(regexp_split_to_array(content, '{WS_RUN}'), lambda x: x <> '') AS w
      FROM {src}) s,
     unnest(generate_series(0, len(s.w) - 1, 750)) AS g(i)
"""


DERIVED["kb_chunks"] = chunk_sql("kb_sources")

DERIVED["kb_postings"] = f"""
SELECT upload_id, chunk_index, tok, n, sum(n * n) OVER (PARTITION BY upload_id, chunk_index) AS n2
FROM (SELECT upload_id, chunk_index, tok, count(*) AS n
      FROM (SELECT upload_id, chunk_index, unnest(regexp_extract_all(lower(content), '{TOKEN_PATTERN}')) AS tok
            FROM kb_chunks) GROUP BY upload_id, chunk_index, tok)
"""

DERIVED["query_terms"] = f"""
SELECT q_id, tok, n, sum(n * n) OVER (PARTITION BY q_id) AS n2
FROM (SELECT q_id, tok, count(*) AS n
      FROM (SELECT q_id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS tok FROM kb_queries)
      GROUP BY q_id, tok)
"""

DERIVED["bench_terms"] = f"""
SELECT item_id, tok, n, sum(n * n) OVER (PARTITION BY item_id) AS n2
FROM (SELECT item_id, tok, count(*) AS n
      FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS tok FROM benchmark)
      GROUP BY item_id, tok)
"""


def topk_sql(qterms: str, dterms: str, qkey: str, dkeys: list[str], k: int = 3) -> str:
    """Per-query top-k over two term tables (qkey, tok, n, n2) and
    (dkeys, tok, n, n2)."""
    dk = ", ".join(f"d.{c}" for c in dkeys)
    dk_plain = ", ".join(dkeys)
    dk_desc = ", ".join(f"{c} DESC" for c in dkeys)
    return f"""
SELECT {qkey}, CAST(rank AS INTEGER) AS rank, {dk_plain}, score FROM (
 SELECT *, row_number() OVER (PARTITION BY {qkey} ORDER BY score DESC, {dk_desc}) AS rank FROM (
  SELECT q.{qkey}, {dk}, sum(q.n * d.n) / (sqrt(any_value(q.n2)) * sqrt(any_value(d.n2))) AS score
  FROM {qterms} q JOIN {dterms} d ON q.tok = d.tok
  GROUP BY q.{qkey}, {dk}) s) r
WHERE rank <= {k}
"""


# ---------------------------------------------------------------- triage chain
_WS = f"^{WS_RUN}|{WS_RUN}$"

DERIVED["resp_text"] = f"""
SELECT email_id, regexp_replace(regexp_replace(regexp_replace(response_text, '{_WS}', '', 'g'),
 '```json|```', '', 'g'), '{_WS}', '', 'g') AS t FROM responses
"""

DERIVED["parsed"] = """
SELECT r.email_id, e.subject,
 CASE WHEN NOT json_valid(r.t) THEN 'fallback'
      WHEN json_type(r.t) = 'OBJECT' AND json_type(r.t, '$.department') = 'VARCHAR'
       AND coalesce(json_type(r.t, '$.intent') NOT IN ('OBJECT', 'ARRAY'), false)
       AND coalesce(json_type(r.t, '$.sentiment') NOT IN ('OBJECT', 'ARRAY'), false)
       AND coalesce(json_type(r.t, '$.urgency') NOT IN ('OBJECT', 'ARRAY'), false)
       AND coalesce(json_type(r.t, '$.key_topics') IN ('ARRAY', 'VARCHAR'), true)
      THEN 'parsed' ELSE 'failed' END AS outcome,
 r.t
FROM resp_text r LEFT JOIN emails e ON r.email_id = e.id
"""

DERIVED["classified"] = """
SELECT email_id, outcome, subject,
 CASE outcome WHEN 'fallback' THEN 'general_inquiry' WHEN 'parsed' THEN json_extract_string(t, '$.intent') END AS intent,
 CASE outcome WHEN 'fallback' THEN 'General' WHEN 'parsed' THEN json_extract_string(t, '$.department') END AS department,
 CASE outcome WHEN 'fallback' THEN 'neutral' WHEN 'parsed' THEN json_extract_string(t, '$.sentiment') END AS sentiment,
 CASE outcome WHEN 'fallback' THEN 'normal' WHEN 'parsed' THEN json_extract_string(t, '$.urgency') END AS urgency,
 CASE outcome WHEN 'fallback' THEN subject WHEN 'parsed' THEN
   CASE WHEN json_type(t, '$.summary') IS NULL THEN subject ELSE json_extract_string(t, '$.summary') END END AS summary,
 CASE outcome WHEN 'fallback' THEN CAST([] AS VARCHAR[]) WHEN 'parsed' THEN
   CASE WHEN json_type(t, '$.key_topics') IS NULL THEN CAST([] AS VARCHAR[])
        ELSE json_extract_string(t, '$.key_topics[*]') END END AS topics
FROM parsed
"""

DERIVED["search_texts"] = """
SELECT email_id, subject || ' ' || coalesce(intent, 'None') || ' ' || array_to_string(topics, ' ') AS search_text
FROM classified WHERE outcome <> 'failed'
"""

DERIVED["sq"] = "SELECT search_text, min(email_id) AS q_id FROM search_texts GROUP BY search_text"

DERIVED["sq_terms"] = f"""
SELECT q_id, tok, n, sum(n * n) OVER (PARTITION BY q_id) AS n2
FROM (SELECT q_id, tok, count(*) AS n
      FROM (SELECT q_id, unnest(regexp_extract_all(lower(search_text), '{TOKEN_PATTERN}')) AS tok FROM sq)
      GROUP BY q_id, tok)
"""

DERIVED["sq_hits"] = topk_sql("sq_terms", "kb_postings", "q_id", ["upload_id", "chunk_index"])

DERIVED["sq_ctx"] = """
SELECT h.q_id, string_agg('Source: ' || coalesce(c.name, 'doc') || chr(10) || substring(c.content, 1, 500),
 chr(10) || chr(10) ORDER BY h.rank) AS rag_context, count(*) AS n_hits
FROM sq_hits h JOIN kb_chunks c ON c.upload_id = h.upload_id AND c.chunk_index = h.chunk_index
GROUP BY h.q_id
"""

DERIVED["kb_ctx"] = """
SELECT CASE WHEN count(*) > 0 THEN string_agg(b, chr(10) || chr(10) ORDER BY created_at, name, chunk_index, id)
 ELSE 'No company knowledge base documents uploaded yet.' END AS kb_context
FROM (SELECT created_at, name, chunk_index, id, '[' || name || ']: ' || substring(content, 1, 800) AS b
      FROM kb_chunks ORDER BY created_at, name, chunk_index, id LIMIT 20)
"""

DERIVED["email_ctx"] = """
SELECT s.email_id, s.search_text, coalesce(x.n_hits, 0) AS n_hits,
 CASE WHEN coalesce(x.n_hits, 0) > 0 THEN x.rag_context
      ELSE (SELECT substring(kb_context, 1, 2000) FROM kb_ctx) END AS rag_context
FROM search_texts s JOIN sq q ON q.search_text = s.search_text LEFT JOIN sq_ctx x ON x.q_id = q.q_id
"""

DERIVED["dept_match"] = """
SELECT lower(name) AS lname, min(ord) AS ord FROM departments GROUP BY lower(name)
"""


def confidence_sql(intent: str, sentiment: str, urgency: str, has_kb: str, body_len: str) -> str:
    """The scoring rule with double literals, in the same addition order."""
    hi = "('general_inquiry', 'order_status', 'billing_question')"
    lo = "('complaint', 'urgent_issue', 'refund_request')"
    z = "CAST(0.0 AS DOUBLE)"
    s = "CAST(0.7 AS DOUBLE)"
    s = (f"(({s} + CASE WHEN {intent} IN {hi} THEN CAST(0.15 AS DOUBLE) ELSE {z} END)"
         f" - CASE WHEN {intent} IN {hi} THEN {z} WHEN {intent} IN {lo} THEN CAST(0.2 AS DOUBLE) ELSE {z} END)")
    s = (f"(({s} - CASE WHEN {sentiment} IN ('angry', 'frustrated') THEN CAST(0.15 AS DOUBLE) ELSE {z} END)"
         f" + CASE WHEN {sentiment} IN ('angry', 'frustrated') THEN {z} WHEN {sentiment} = 'positive'"
         f" THEN CAST(0.05 AS DOUBLE) ELSE {z} END)")
    s = (f"({s} - CASE WHEN {urgency} = 'critical' THEN CAST(0.3 AS DOUBLE) WHEN {urgency} = 'high'"
         f" THEN CAST(0.1 AS DOUBLE) ELSE {z} END)")
    s = f"({s} + CASE WHEN {has_kb} THEN CAST(0.1 AS DOUBLE) ELSE {z} END)"
    s = f"({s} - CASE WHEN {body_len} < 50 THEN CAST(0.1 AS DOUBLE) ELSE {z} END)"
    return f"greatest(CAST(0.1 AS DOUBLE), least(CAST(0.99 AS DOUBLE), {s}))"


BODY_SQL = ("CASE WHEN coalesce(text_body, '') <> '' THEN text_body "
            "ELSE substring(coalesce(html_body, ''), 1, 2000) END")


def _triage_view(simulate: bool) -> str:
    conf = confidence_sql("c.intent", "c.sentiment", "c.urgency", "coalesce(x.n_hits, 0) > 0",
                          f"length({BODY_SQL.replace('text_body', 'e.text_body').replace('html_body', 'e.html_body')})")
    status_live = "'pending_approval'" if simulate else \
        "CASE WHEN conf >= thr THEN 'auto_sent' ELSE 'pending_approval' END"
    msg_id = "'<simulate-' || id || '@local>'" if simulate else "message_id"
    return f"""
SELECT id, {msg_id} AS message_id,
 CASE WHEN outcome = 'failed' THEN 'failed' ELSE {status_live} END AS status,
 CASE WHEN outcome = 'failed' THEN NULL ELSE department END AS department,
 CASE WHEN outcome = 'failed' THEN NULL ELSE intent END AS intent,
 CASE WHEN outcome = 'failed' THEN NULL ELSE sentiment END AS sentiment,
 CASE WHEN outcome = 'failed' THEN 'normal' ELSE urgency END AS urgency,
 CASE WHEN outcome = 'failed' THEN CAST(0.0 AS DOUBLE) ELSE conf END AS confidence_score,
 CASE WHEN outcome = 'failed' THEN NULL ELSE 'Classified as ' || coalesce(intent, 'None') || ' for '
   || coalesce(department, 'None') || '. Sentiment: ' || coalesce(sentiment, 'None') || '. '
   || CASE WHEN has_kb THEN 'Used knowledge base.' ELSE 'No specific KB match found.' END END AS ai_reasoning,
 CASE WHEN outcome = 'failed' THEN false ELSE has_kb END AS has_kb,
 received_at, outcome, conf, thr, tone, signature, rag_context, sender_name, sender_email, subject, body
FROM (
 SELECT e.id, e.message_id, e.received_at, e.sender_name, e.sender_email, e.subject,
  {BODY_SQL.replace('text_body', 'e.text_body').replace('html_body', 'e.html_body')} AS body,
  c.outcome, c.intent, c.department, c.sentiment, c.urgency,
  coalesce(x.n_hits, 0) > 0 AS has_kb, x.rag_context, {conf} AS conf,
  coalesce(rd.auto_send_threshold, 0.95) AS thr, coalesce(rd.tone, 'professional') AS tone,
  coalesce(rd.signature, 'Best regards,' || chr(10) || 'Support Team') AS signature
 FROM emails e JOIN classified c ON c.email_id = e.id
 LEFT JOIN email_ctx x ON x.email_id = e.id
 LEFT JOIN dept_match dm ON dm.lname = lower(c.department)
 LEFT JOIN departments rd ON rd.ord = coalesce(dm.ord, (SELECT max(ord) FROM departments))
) t
"""


DERIVED["triaged"] = _triage_view(False)
DERIVED["simulated"] = _triage_view(True)
