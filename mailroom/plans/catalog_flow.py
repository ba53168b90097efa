"""Registry entries for ingest, triage, decisions and outbox keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.mail import select_body
from ..operators import classify as C
from ..operators import decisions as D
from ..operators import ingest as I
from ..operators import knowledge as KB
from ..operators import outbox as O
from ..operators.similarity import search_query
from ..session import scratch_path
from ..sources import mail as M
from ..sources.fixtures import COMPANY, SMTP_USER
from ..functions.text import WS_RUN
from .catalog import _chunks, _fx, ntz, register
from .oracle_views import BODY_SQL, chunk_sql, confidence_sql, DERIVED
from .triage import classify_requests, regenerate_requests, triage

STORED_BEFORE = "2024-01-16 00:00:00"   # messages received earlier are already stored
_WS = f"^{WS_RUN}|{WS_RUN}$"

# ------------------------------------------------------------------ derived oracle views (flow)

DERIVED["dedup_all"] = """
SELECT message_id, id, received_at, subject FROM (
 SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at, id) AS rn FROM (
  SELECT coalesce(message_id, '<generated-' || id || '>') AS message_id, id, received_at, subject FROM raw_messages))
WHERE rn = 1
"""
DERIVED["dept_observed"] = """
SELECT DISTINCT CAST(NULL AS INTEGER) AS ord, 'obs_' || department AS id, department AS name
FROM emails WHERE department IS NOT NULL
"""
DERIVED["send_res"] = """
SELECT id AS email_id, event_id % 23 <> 0 AS ok, received_at + INTERVAL 1 MINUTE AS sent_at FROM emails
"""
DERIVED["dec_known"] = "SELECT d.*, e.ai_draft AS orig_draft FROM decisions d JOIN emails e ON d.email_id = e.id"
DERIVED["dec_approvals"] = """
SELECT email_id, seq, "at", final_reply, human_edited FROM (
 SELECT email_id, seq, "at", reply_body,
  CASE WHEN coalesce(reply_body, '') <> '' THEN reply_body ELSE draft_then END AS final_reply,
  CASE WHEN coalesce(reply_body, '') <> '' AND (draft_then IS NULL OR reply_body <> draft_then) THEN 1 ELSE 0 END AS human_edited,
  action FROM (
  SELECT *, CASE WHEN has_prev THEN prev_regen ELSE orig_draft END AS draft_then FROM (
   SELECT *, last_value(CASE WHEN action = 'regenerate' THEN new_draft END IGNORE NULLS) OVER
     (PARTITION BY email_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_regen,
    count(CASE WHEN action = 'regenerate' THEN 1 END) OVER
     (PARTITION BY email_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS has_prev
   FROM dec_known)))
WHERE action = 'approve'
"""
DERIVED["dec_state"] = """
SELECT e.id,
 coalesce(st.s, e.status) AS status,
 CASE WHEN rg.d IS NOT NULL THEN rg.d ELSE e.ai_draft END AS ai_draft,
 ap.final_reply, ap."at" AS replied_at, coalesce(ap.human_edited, 0) AS human_edited,
 CASE WHEN ap.email_id IS NOT NULL THEN 0 ELSE e.auto_sent END AS auto_sent
FROM emails e
LEFT JOIN (SELECT email_id, arg_max(CASE WHEN action = 'approve' THEN 'sent' ELSE 'rejected' END, seq) AS s
           FROM dec_known WHERE action IN ('approve', 'reject') GROUP BY email_id) st ON st.email_id = e.id
LEFT JOIN (SELECT email_id, arg_max(new_draft, seq) AS d FROM dec_known WHERE action = 'regenerate'
           GROUP BY email_id) rg ON rg.email_id = e.id
LEFT JOIN (SELECT email_id, arg_max(final_reply, seq) AS final_reply, arg_max(human_edited, seq) AS human_edited,
           arg_max("at", seq) AS "at" FROM dec_approvals GROUP BY email_id) ap ON ap.email_id = e.id
"""
DERIVED["dec_activity"] = """
SELECT 'dec-' || CAST(seq AS VARCHAR) AS id, email_id, 'approved_sent' AS action, 'human' AS actor,
 CASE WHEN human_edited = 1 THEN 'Edited and sent' ELSE 'Approved AI draft' END AS details, "at" AS created_at
FROM dec_approvals
UNION ALL
SELECT 'dec-' || CAST(seq AS VARCHAR), email_id, 'draft_regenerated', 'human',
 CASE WHEN coalesce(custom_instructions, '') <> '' THEN 'Custom: ' || custom_instructions ELSE 'Regenerated' END, "at"
FROM dec_known WHERE action = 'regenerate'
UNION ALL
SELECT 'dec-' || CAST(seq AS VARCHAR), email_id, 'rejected', 'human', NULL, "at" FROM decisions WHERE action = 'reject'
"""
DERIVED["text_uploads"] = """
SELECT doc_id AS upload_id,
 coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || '/' || CAST(doc_id AS VARCHAR) END, 'Manual Entry') AS name,
 'text' AS file_type,
 coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, 'general') AS department,
 CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 50 = 1 THEN '   ' ELSE text END AS content,
 TIMESTAMP '2024-02-01 00:00:00' AS created_at
FROM documents
"""
DERIVED["text_chunks"] = chunk_sql("(SELECT * FROM text_uploads WHERE content <> '')")
DERIVED["file_uploads"] = f"""
SELECT page_id AS upload_id, CAST(page_id AS VARCHAR) || '.html' AS name, 'text/html' AS file_type,
 'general' AS department, CASE WHEN page_id % 50 = 0 THEN ' ' || chr(10) ELSE html END AS content,
 TIMESTAMP '2024-02-01 00:00:00' AS created_at
FROM pages
"""
DERIVED["file_chunks"] = chunk_sql(
    f"(SELECT * FROM file_uploads WHERE regexp_replace(content, '{_WS}', '', 'g') <> '')")


def _parsed(fx, filtered: bool = True):
    # persisted when a filter on ``outcome`` follows: it then reads stored
    # rows rather than inlining the JSON parse (see plans/triage.py)
    p = C.parse_responses(fx.responses, fx.emails)
    return p.persist() if filtered else p


# ------------------------------------------------------------------ parsing and routing

@register("parse_responses", """
SELECT email_id, outcome, intent, department, sentiment, urgency, summary,
 array_to_string(topics, ' ') AS topics, CAST(len(topics) AS BIGINT) AS n_topics FROM classified""")
def _parse_responses(spark, d):
    p = _parsed(_fx(spark, d), filtered=False)
    return p.select("email_id", "outcome", "intent", "department", "sentiment", "urgency", "summary",
                    F.array_join("topics", " ").alias("topics"),
                    F.when(F.col("topics").isNotNull(), F.size("topics")).cast("bigint").alias("n_topics"))


@register("dept_resolve", """
SELECT c.email_id, c.department, rd.name AS dept_name, rd.tone, rd.signature, rd.auto_send_threshold
FROM classified c LEFT JOIN dept_match dm ON dm.lname = lower(c.department)
LEFT JOIN departments rd ON rd.ord = coalesce(dm.ord, (SELECT max(ord) FROM departments))
WHERE c.outcome <> 'failed'""")
def _dept_resolve(spark, d):
    fx = _fx(spark, d)
    p = _parsed(fx).filter(F.col("outcome") != C.OUTCOME_FAILED).select("email_id", "department")
    return C.resolve_department(p, fx.departments).select(
        "email_id", "department", "dept_name", "tone", "signature", "auto_send_threshold")


_STORED_CONF = confidence_sql("intent", "sentiment", "urgency", "event_id % 2 = 0", f"length({BODY_SQL})")


def _stored_scored(fx):
    e = fx.emails.withColumn("_kb", F.col("event_id") % 2 == 0).withColumn(
        "_chars", F.length(select_body("text_body", "html_body")))
    return C.score(e.drop("confidence_score"), "_kb", "_chars")


register("confidence", f"SELECT id, {_STORED_CONF} AS confidence_score FROM emails")(
    lambda spark, d: _stored_scored(_fx(spark, d)).select("id", "confidence_score"))


@register("auto_send_route", f"""
SELECT e.id, conf AS confidence_score, rd.auto_send_threshold,
 CASE WHEN conf >= rd.auto_send_threshold THEN 'auto_sent' ELSE 'pending_approval' END AS status
FROM (SELECT *, {_STORED_CONF} AS conf FROM emails) e
LEFT JOIN dept_match dm ON dm.lname = lower(e.department)
LEFT JOIN departments rd ON rd.ord = coalesce(dm.ord, (SELECT max(ord) FROM departments))""")
def _auto_send_route(spark, d):
    fx = _fx(spark, d)
    s = C.resolve_department(_stored_scored(fx), fx.departments)
    return s.select("id", "confidence_score", "auto_send_threshold",
                    C.route(F.col("confidence_score"), F.col("auto_send_threshold"), True).alias("status"))


@register("reasoning_text", f"""
SELECT id, 'Classified as ' || coalesce(intent, 'None') || ' for ' || coalesce(department, 'None')
 || '. Sentiment: ' || coalesce(sentiment, 'None') || '. '
 || CASE WHEN event_id % 2 = 0 THEN 'Used knowledge base.' ELSE 'No specific KB match found.' END AS ai_reasoning,
 'Intent: ' || coalesce(intent, 'None') || ', Confidence: ' || printf('%.0f%%', {_STORED_CONF} * 100) AS details
FROM emails""")
def _reasoning_text(spark, d):
    s = _stored_scored(_fx(spark, d))
    return s.select("id", C.reasoning(F.col("intent"), F.col("department"), F.col("sentiment"), F.col("_kb"))
                    .alias("ai_reasoning"), C.log_detail(F.col("intent"), F.col("confidence_score")).alias("details"))


@register("search_query", "SELECT email_id, search_text FROM search_texts")
def _search_query(spark, d):
    # one set of views: registering them again would drop what is persisted, and
    # the parse would be inlined into every use of a parsed column
    fx = _fx(spark, d)
    p = _parsed(fx).filter(F.col("outcome") != C.OUTCOME_FAILED)
    return p.join(fx.emails.select(F.col("id").alias("email_id"), F.col("subject").alias("_subj")),
                  "email_id").select("email_id", search_query(F.col("_subj"), F.col("intent"), F.col("topics"))
                                     .alias("search_text"))


def _triage(spark, d, simulate=False):
    fx = _fx(spark, d)
    return triage(fx.emails, fx.responses, _chunks(fx), fx.departments, auto_send_enabled=True,
                  simulate=simulate)


_STATE_COLS = ["id", "message_id", "status", "department", "intent", "sentiment", "urgency",
               "confidence_score", "ai_reasoning", "has_kb", "received_at"]

register("rag_context", "SELECT email_id, search_text, rag_context, n_hits FROM email_ctx")(
    lambda spark, d: _triage(spark, d).context)
register("triage", f"SELECT {', '.join(_STATE_COLS)} FROM triaged")(
    lambda spark, d: _triage(spark, d).state.select(*_STATE_COLS))
register("simulate_triage", f"SELECT {', '.join(_STATE_COLS)} FROM simulated")(
    lambda spark, d: _triage(spark, d, simulate=True).state.select(*_STATE_COLS))

_DEPT_LIST = "(SELECT string_agg(name || ' (' || description || ')', ', ' ORDER BY ord) FROM departments)"
register("classify_requests", "SELECT id AS email_id, " + P.render_sql(
    P.CLASSIFY, sender_name="coalesce(sender_name, '')", sender_email="coalesce(sender_email, '')",
    subject="coalesce(subject, '')", body=f"substring({BODY_SQL}, 1, 1500)",
    departments=f"coalesce({_DEPT_LIST}, '')") + " AS prompt FROM emails")(
    lambda spark, d: classify_requests(_fx(spark, d).emails, _fx(spark, d).departments))

register("reply_requests", "SELECT id AS email_id, " + P.render_sql(
    P.REPLY, context=f"coalesce(nullif(rag_context, ''), '{C.NO_KNOWLEDGE}')",
    sender_name="coalesce(nullif(sender_name, ''), 'Customer')", sender_email="coalesce(sender_email, '')",
    subject="coalesce(subject, '')", body="substring(coalesce(body, ''), 1, 2000)",
    intent="coalesce(intent, 'None')", department="coalesce(department, 'None')",
    sentiment="coalesce(sentiment, 'None')", urgency="coalesce(urgency, 'None')",
    tone="coalesce(tone, '')", signature="coalesce(signature, '')") + " AS prompt FROM triaged WHERE outcome <> 'failed'")(
    lambda spark, d: _triage(spark, d).reply_requests)

register("regenerate_requests", "SELECT d.email_id, d.seq, " + P.render_sql(
    P.REGENERATE, context="substring(coalesce((SELECT kb_context FROM kb_ctx), ''), 1, 2000)",
    sender_name="coalesce(e.sender_name, 'None')", sender_email="coalesce(e.sender_email, 'None')",
    subject="coalesce(e.subject, 'None')",
    body="substring(coalesce(" + BODY_SQL.replace("text_body", "e.text_body").replace("html_body", "e.html_body")
    + ", ''), 1, 2000)", intent="coalesce(e.intent, 'None')", sentiment="coalesce(e.sentiment, 'None')",
    department="coalesce(e.department, 'None')",
    extra="CASE WHEN coalesce(d.custom_instructions, '') <> '' THEN chr(10) || 'Extra instructions: ' || "
          "d.custom_instructions ELSE '' END")
    + " AS prompt FROM decisions d JOIN emails e ON e.id = d.email_id WHERE d.action = 'regenerate'")(
    lambda spark, d: regenerate_requests(_fx(spark, d).emails, _fx(spark, d).decisions, _chunks(_fx(spark, d))))


def _send_results(fx):
    return fx.emails.select(F.col("id").alias("email_id"), (F.col("event_id") % 23 != 0).alias("ok"),
                            (F.col("received_at") + F.expr("INTERVAL 1 MINUTE")).alias("sent_at"))


@register("send_results", """
SELECT t.id, CASE WHEN t.status = 'auto_sent' AND NOT r.ok THEN 'failed' ELSE t.status END AS status,
 CASE WHEN t.status = 'auto_sent' AND r.ok THEN 1 ELSE 0 END AS auto_sent,
 CASE WHEN t.status = 'auto_sent' AND r.ok THEN r.sent_at END AS replied_at
FROM triaged t LEFT JOIN send_res r ON r.email_id = t.id""")
def _send_results_q(spark, d):
    fx = _fx(spark, d)
    state, _ = C.apply_send_results(_triage(spark, d).state, _send_results(fx))
    return state.select("id", "status", "auto_sent", ntz("replied_at"))


# ------------------------------------------------------------------ ingest and dedup

register("parse_sender", f"""
SELECT id, sender_raw,
 CASE WHEN strpos(sender_raw, '<') > 0 THEN regexp_replace(regexp_replace(split_part(sender_raw, '<', 1),
   '{_WS}', '', 'g'), '^"+|"+$', '', 'g') ELSE '' END AS sender_name,
 CASE WHEN strpos(sender_raw, '<') > 0 THEN regexp_replace(regexp_replace(split_part(sender_raw, '<', 2),
   '>+$', '', 'g'), '{_WS}', '', 'g') ELSE regexp_replace(sender_raw, '{_WS}', '', 'g') END AS sender_email
FROM raw_messages""")(lambda spark, d: I.with_sender(_fx(spark, d).raw_messages).select(
    "id", "sender_raw", "sender_name", "sender_email"))
register("body_select", f"SELECT id, {BODY_SQL} AS body_text FROM raw_messages")(
    lambda spark, d: I.with_body(_fx(spark, d).raw_messages).select("id", "body_text"))
register("message_dedup", "SELECT message_id, id, received_at, subject FROM dedup_all")(
    lambda spark, d: I.message_dedup(_fx(spark, d).raw_messages.select(
        "id", "message_id", "received_at", "subject")).select("message_id", "id", "received_at", "subject"))


@register("insert_or_ignore", f"""
SELECT message_id, id, received_at, 'processing' AS status FROM dedup_all
WHERE message_id NOT IN (
 SELECT message_id FROM (
  SELECT coalesce(message_id, '<generated-' || id || '>') AS message_id, received_at FROM raw_messages)
 WHERE received_at < TIMESTAMP '{STORED_BEFORE}')""")
def _insert_or_ignore(spark, d):
    raw = _fx(spark, d).raw_messages.select("id", "message_id", "received_at", "subject")
    stored = I.message_dedup(raw.filter(F.col("received_at") < F.lit(STORED_BEFORE).cast("timestamp_ntz")))
    return I.insert_or_ignore(stored, raw).select("message_id", "id", "received_at", "status")


@register("ingest_rfc822", """
SELECT id, message_id, ltrim(sender_name || ' <' || sender_email || '>') AS sender_raw,
 sender_name, sender_email,
 'Ticket ' || CAST(event_id AS VARCHAR) AS subject,
 CASE WHEN event_id % 2 = 0 THEN text_body ELSE '' END AS text_body,
 CASE WHEN event_id % 2 = 1 THEN text_body ELSE '' END AS html_body
FROM emails""")
def _ingest_rfc822(spark, d):
    raw = _fx(spark, d).raw_mail.select("id", F.encode("content", "UTF-8").alias("content"))
    ok, _dead = M.ingest_rfc822(raw)
    return ok


@register("dim_departments", """
SELECT ord, id, name FROM dept_observed
UNION ALL SELECT * FROM (VALUES (1, 'dept_support', 'Support'), (2, 'dept_billing', 'Billing'),
 (3, 'dept_sales', 'Sales'), (4, 'dept_general', 'General')) AS s(ord, id, name)
WHERE s.id NOT IN (SELECT id FROM dept_observed) AND s.name NOT IN (SELECT name FROM dept_observed)""")
def _dim_departments(spark, d):
    e = (_fx(spark, d).emails.filter(F.col("department").isNotNull()).select("department").distinct()
         .select(F.lit(None).cast("int").alias("ord"), F.concat(F.lit("obs_"), "department").alias("id"),
                 F.col("department").alias("name"), F.lit(None).cast("string").alias("description"),
                 F.lit("professional").alias("tone"), F.lit(None).cast("string").alias("signature"),
                 F.lit(0.95).alias("auto_send_threshold")))
    return I.departments(spark, e).select("ord", "id", "name")


@register("kb_ingest_text", """
SELECT upload_id, name, department, chunk_index, content FROM text_chunks""")
def _kb_ingest_text(spark, d):
    docs = _fx(spark, d).documents
    rows = docs.select(
        F.col("doc_id").alias("upload_id"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("name"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang")).alias("department"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("")).when(F.col("doc_id") % 50 == 1, F.lit("   "))
        .otherwise(F.col("text")).alias("content"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("created_at"))
    ok, _rej = KB.kb_ingest_text(rows)
    return KB.chunk(ok).select("upload_id", "name", "department", "chunk_index", "content")


@register("kb_ingest_files", "SELECT upload_id, name, file_type, chunk_index, content FROM file_chunks")
def _kb_ingest_files(spark, d):
    pages = _fx(spark, d).pages
    files = pages.select(
        F.col("page_id").alias("upload_id"),
        F.concat(F.lit("uploads/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode(F.when(F.col("page_id") % 50 == 0, F.lit(" \n")).otherwise(F.col("html")), "UTF-8").alias("content"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("created_at"))
    ok, _rej = KB.kb_ingest_files(files)
    return KB.chunk(ok).select("upload_id", "name", "file_type", "chunk_index", "content")


# ------------------------------------------------------------------ decisions, outbox, activity

register("apply_decisions", "SELECT * FROM dec_state")(
    lambda spark, d: D.apply_decisions(_fx(spark, d).emails, _fx(spark, d).decisions)[0])

_REPLY_SQL = f"""
SELECT id AS email_id, CASE WHEN starts_with(coalesce(subject, ''), 'Re:') THEN coalesce(subject, '')
 ELSE 'Re: ' || coalesce(subject, '') END AS subject,
 '{COMPANY} <{SMTP_USER}>' AS from_addr,
 CASE WHEN coalesce(sender_name, '') <> '' THEN sender_name || ' <' || sender_email || '>' ELSE sender_email END AS to_addr,
 nullif(message_id, '') AS in_reply_to, nullif(message_id, '') AS "references",
 coalesce(ai_draft, '') AS text_body,
 '<html><body>' || replace(coalesce(ai_draft, ''), chr(10), '<br>') || '</body></html>' AS html_body"""

register("compose_reply", _REPLY_SQL + " FROM emails")(
    lambda spark, d: O.compose_reply(_fx(spark, d).emails, COMPANY, SMTP_USER))


# Drafts come back for the triaged messages: white space around the text, a
# failed call (null) for some, none at all for others.
_DRAFT_SQL = """
SELECT id AS email_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE chr(10) || ' ' || ai_draft || '  ' END AS draft_text
FROM emails WHERE event_id % 7 <> 0"""

_DRAFTED_SQL = f"""
SELECT t.id, CASE WHEN t.status <> 'failed' AND d.email_id IS NOT NULL AND d.draft_text IS NULL THEN 'failed' ELSE t.status END AS status,
 CASE WHEN t.status <> 'failed' AND d.email_id IS NOT NULL AND d.draft_text IS NULL THEN NULL ELSE t.department END AS department,
 CASE WHEN t.status <> 'failed' AND d.email_id IS NOT NULL AND d.draft_text IS NULL THEN CAST(0.0 AS DOUBLE) ELSE t.confidence_score END AS confidence_score,
 CASE WHEN t.status <> 'failed' THEN trim(regexp_replace(d.draft_text, '^\\s+|\\s+$', '', 'g')) END AS ai_draft
FROM triaged t LEFT JOIN ({_DRAFT_SQL}) d ON d.email_id = t.id"""


@register("apply_drafts", _DRAFTED_SQL)
def _apply_drafts(spark, d):
    state = _triage(spark, d).state
    drafts = spark.sql(_DRAFT_SQL)
    return C.apply_drafts(state, drafts).select("id", "status", "department", "confidence_score", "ai_draft")


@register("outbox", "SELECT email_id, subject, to_addr, text_body, day FROM (" + _REPLY_SQL.replace("ai_draft", "reply_text")
          + """, CAST(received_at AS DATE) AS day FROM (
 SELECT e.* EXCLUDE (status, ai_draft), CASE WHEN s.status = 'sent' THEN coalesce(s.final_reply, s.ai_draft) ELSE s.ai_draft END AS reply_text
 FROM emails e JOIN dec_state s ON s.id = e.id WHERE s.status IN ('auto_sent', 'sent')))""")
def _outbox(spark, d):
    """Replies of the messages that are auto-sent or approved after the
    decisions; the state carries what the reply is made of."""
    fx = _fx(spark, d)
    state, _ = D.apply_decisions(fx.emails, fx.decisions)
    e = fx.emails.select("id", "message_id", "sender_name", "sender_email", "subject", F.to_date("received_at").alias("day"))
    sent = O.outgoing(state.select("id", "status", "ai_draft", "final_reply")).join(e, "id")
    path = scratch_path(spark, "outbox")
    O.write_outbox(O.compose_reply(sent, COMPANY, SMTP_USER, "reply_text", ("day",)), path, "run-1")
    return spark.read.parquet(path).select("email_id", "subject", "to_addr", "text_body", "day")


@register("activity_append", """
SELECT 'ai-' || id AS id, id AS email_id, 'ai_processed' AS action, 'ai' AS actor,
 'Intent: ' || coalesce(intent, 'None') || ', Confidence: ' || printf('%.0f%%', conf * 100) AS details,
 received_at AS created_at FROM triaged WHERE outcome <> 'failed'
UNION ALL
SELECT 'send-' || t.id, t.id, 'auto_sent', 'ai', 'Auto-sent based on confidence score', r.sent_at
FROM triaged t JOIN send_res r ON r.email_id = t.id WHERE t.status = 'auto_sent' AND r.ok
UNION ALL SELECT * FROM dec_activity""")
def _activity_append(spark, d):
    fx = _fx(spark, d)
    tri = _triage(spark, d)
    _, send_acts = C.apply_send_results(tri.state, _send_results(fx))
    _, dec_acts = D.apply_decisions(fx.emails, fx.decisions)
    cols = ["id", "email_id", "action", "actor", "details", "created_at"]
    parts = [tri.activity, send_acts, dec_acts]
    path = scratch_path(spark, "activity")
    for n, p in enumerate(parts):   # each producer writes its rows by run: repeated, it replaces them
        p.select(*cols[:-1], F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.lit(f"run-{n}").alias("run_id")) \
            .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path).select(*cols)
