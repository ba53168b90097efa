"""Application tables derived from the driver's Parquet (see FIXTURES.md).

Each view is one SQL text that runs unchanged in Spark SQL and DuckDB, so an
operator and its oracle read the same rows. Spark registers them as temp
views; the oracle inlines them as CTEs (``with_views``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.ingest import SEED_DEPARTMENTS
from ..session import prepare
from .tables import BASE_SCHEMAS, register_base

# Fixed parameters of the fixtures.
AS_OF = "2024-01-31 00:00:00"          # "now" for every last-7-days op
COMPANY = "Our Company"
SMTP_USER = "support@example.com"

# Ordered: each view may read the ones before it.
VIEWS: dict[str, str] = {}

# The seeded departments, one line each, with one threshold that auto-send meets.
_THRESHOLDS = {"Sales": 0.8}


def _department_rows() -> str:
    rows = []
    for ord_, ident, name, *texts, threshold in SEED_DEPARTMENTS:
        quoted = ", ".join("'" + t.replace("\n", " ").replace("'", "''") + "'" for t in (ident, name, *texts))
        rows.append(f" ({ord_}, {quoted}, CAST({_THRESHOLDS.get(name, threshold)} AS DOUBLE))")
    return ",\n".join(rows)


VIEWS["departments"] = f"""
SELECT * FROM (VALUES
{_department_rows()}
) AS t(ord, id, name, description, tone, signature, auto_send_threshold)
"""

VIEWS["emails"] = """
WITH b AS (SELECT e.*, e.event_id % (SELECT count(*) FROM documents) AS did, e.event_id % (SELECT count(*) FROM benchmark) AS sid FROM events e)
SELECT
 b.event_id AS event_id,
 'm' || CAST(b.event_id AS STRING) AS id,
 '<m' || CAST(b.event_id AS STRING) || '@example.com>' AS message_id,
 CASE WHEN b.event_id % 4 = 0 THEN '' ELSE 'User ' || CAST(b.user_id AS STRING) END AS sender_name,
 'user' || CAST(b.user_id AS STRING) || '@example.com' AS sender_email,
 CASE WHEN b.event_id % 11 = 0 THEN 'Re: ' ELSE '' END || replace(s.text, chr(10), ' ') AS subject,
 CASE WHEN b.event_id % 20 = 0 THEN '' WHEN b.event_id % 13 = 0 THEN d.source ELSE d.text END AS text_body,
 CASE WHEN b.event_id % 20 = 0 OR b.event_id % 3 = 0 THEN '<p>' || d.text || '</p>' ELSE '' END AS html_body,
 b.ts AS received_at,
 CASE CAST(floor(b.event_id / 5) AS BIGINT) % 6 WHEN 0 THEN 'pending_approval' WHEN 1 THEN 'auto_sent' WHEN 2 THEN 'sent' WHEN 3 THEN 'rejected' WHEN 4 THEN 'failed' ELSE 'processing' END AS status,
 CASE b.event_id % 10 WHEN 0 THEN NULL WHEN 4 THEN 'Billing' WHEN 5 THEN 'billing' WHEN 6 THEN 'Sales' WHEN 7 THEN 'General' WHEN 8 THEN 'Legal' ELSE 'Support' END AS department,
 CASE b.event_id % 9 WHEN 0 THEN 'support_request' WHEN 1 THEN 'billing_question' WHEN 2 THEN 'refund_request' WHEN 3 THEN 'order_status' WHEN 4 THEN 'complaint' WHEN 5 THEN 'partnership_inquiry' WHEN 6 THEN 'general_inquiry' WHEN 7 THEN 'spam' ELSE 'urgent_issue' END AS intent,
 CASE CAST(floor(b.event_id / 9) AS BIGINT) % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'frustrated' WHEN 3 THEN 'angry' WHEN 4 THEN 'confused' ELSE 'excited' END AS sentiment,
 CASE CAST(floor(b.event_id / 54) AS BIGINT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS urgency,
 CASE WHEN CAST(floor(b.event_id / 5) AS BIGINT) % 6 >= 4 THEN CAST(0 AS DOUBLE) ELSE CAST((b.event_id % 18) * 5 + 10 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence_score,
 'draft ' || CAST(b.event_id AS STRING) AS ai_draft,
 CASE WHEN CAST(floor(b.event_id / 5) AS BIGINT) % 6 = 1 THEN 1 ELSE 0 END AS auto_sent
FROM b JOIN documents d ON d.doc_id = b.did JOIN benchmark s ON s.item_id = b.sid
"""

VIEWS["raw_messages"] = """
SELECT event_id,
 id,
 CASE WHEN event_id % 101 = 0 THEN NULL ELSE '<' || sender_email || '.' || CAST(event_id % 7 AS STRING) || '.' || CAST(CAST(received_at AS DATE) AS STRING) || '>' END AS message_id,
 CASE event_id % 5 WHEN 0 THEN sender_email WHEN 1 THEN '"' || 'User, ' || sender_email || '" <' || sender_email || '>' WHEN 2 THEN '<' || sender_email || '>' WHEN 3 THEN 'User <' || sender_email || '>>' ELSE ' ' || sender_email || ' ' END AS sender_raw,
 subject, text_body, html_body, received_at
FROM emails
"""

VIEWS["responses"] = """
SELECT id AS email_id, CASE event_id % 12
 WHEN 0 THEN 'Sorry, I cannot do that'
 WHEN 1 THEN '```json' || chr(10) || full_json || chr(10) || '```'
 WHEN 2 THEN '[1,2]'
 WHEN 3 THEN '{"intent":"' || intent || '","department":"Support","sentiment":"' || sentiment || '"}'
 WHEN 4 THEN '{"intent":"' || intent || '","department":"' || coalesce(department, 'Nowhere') || '","sentiment":"' || sentiment || '","urgency":"' || urgency || '"}'
 WHEN 5 THEN '{"intent":"spam"'
 ELSE full_json END AS response_text
FROM (SELECT *, '{"intent":"' || intent || '","department":"' || coalesce(department, 'Nowhere') || '","sentiment":"' || sentiment || '","urgency":"' || urgency || '","summary":"msg ' || CAST(event_id AS STRING) || '","key_topics":["topic' || CAST(event_id % 7 AS STRING) || '","the"]}' AS full_json FROM emails) AS x
"""

VIEWS["kb_sources"] = """
SELECT doc_id AS upload_id,
 source || '/' || CAST(doc_id % 100 AS STRING) || '.txt' AS name,
 'text/plain' AS file_type,
 CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'support' WHEN 'de' THEN 'billing' ELSE 'sales' END AS department,
 text AS content,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(floor(doc_id / 10) AS INT) * INTERVAL '1' SECOND AS created_at
FROM documents
"""

VIEWS["activity_log"] = """
SELECT 'a' || CAST(event_id AS STRING) AS id,
 CASE WHEN event_id % 17 = 0 THEN 'ghost' ELSE 'm' END || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) AS email_id,
 CASE event_id % 5 WHEN 0 THEN 'ai_processed' WHEN 1 THEN 'auto_sent' WHEN 2 THEN 'approved_sent' WHEN 3 THEN 'rejected' ELSE 'draft_regenerated' END AS action,
 CASE WHEN event_id % 5 < 2 THEN 'ai' ELSE 'human' END AS actor,
 CASE WHEN event_id % 5 = 3 THEN NULL ELSE 'detail ' || CAST(event_id % 23 AS STRING) END AS details,
 date_trunc('hour', ts) AS created_at
FROM events
"""

VIEWS["decisions"] = """
SELECT CASE WHEN event_id % 29 = 0 THEN 'ghost' ELSE 'm' END || CAST(event_id % 280 AS STRING) AS email_id,
 event_id AS seq,
 ts AS at,
 CASE CAST(floor(event_id / 4) AS BIGINT) % 3 WHEN 0 THEN 'regenerate' WHEN 1 THEN 'approve' ELSE 'reject' END AS action,
 CASE CAST(floor(event_id / 12) AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'draft ' || CAST(event_id % 280 AS STRING) ELSE 'edited ' || CAST(event_id AS STRING) END AS reply_body,
 CASE WHEN CAST(floor(event_id / 4) AS BIGINT) % 3 = 0 THEN 'redraft ' || CAST(event_id AS STRING) ELSE NULL END AS new_draft,
 CASE WHEN event_id % 3 = 0 THEN 'be brief' ELSE NULL END AS custom_instructions
FROM events
"""

VIEWS["kb_queries"] = """
SELECT conv_id * 100 + turn AS q_id, text, role FROM conversations
"""

VIEWS["raw_mail"] = """
SELECT id, 'From: ' || sender_name || ' <' || sender_email || '>' || chr(10) || 'Message-ID: ' || message_id || chr(10) || 'Subject: Ticket ' || CAST(event_id AS STRING) || chr(10) || 'MIME-Version: 1.0' || chr(10) || 'Content-Type: ' || CASE WHEN event_id % 2 = 0 THEN 'text/plain' ELSE 'text/html' END || '; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || text_body AS content
FROM emails
"""

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _deps(name: str, views: dict[str, str]) -> list[str]:
    """Views (transitively) read by ``name``, in registration order."""
    need: set[str] = set()

    def visit(n: str) -> None:
        for w in set(_WORD.findall(views[n])):
            if w in views and w != n and w not in need:
                need.add(w)
                visit(w)

    visit(name)
    return [v for v in views if v in need]


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the fixture views (and ``extra`` derived views)
    it needs, as CTEs, for the DuckDB oracle."""
    views = dict(VIEWS)
    views.update(extra or {})
    words = set(_WORD.findall(sql))
    need: set[str] = set()
    for v in views:
        if v in words:
            need.update(_deps(v, views))
            need.add(v)
    order = [v for v in views if v in need]
    if not order:
        return sql
    ctes = ",\n".join(f"{v} AS (\n{views[v].strip()}\n)" for v in order)
    return f"WITH {ctes}\n{sql}"


class Fixtures:
    """Lazily built fixture DataFrames for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        register_base(spark, sf_dir)
        for name, sql in VIEWS.items():
            spark.sql(sql).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in BASE_SCHEMAS:
            return self.spark.table(name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)
