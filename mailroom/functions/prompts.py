"""Prompt templates for the model request tables (M1, M7, M8).

A template is a list of literal strings and ``{field}`` slots. The same
template renders to a Spark ``concat`` and to a SQL ``||`` expression, so
the request tables and their oracle agree by construction.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value lists of the classification contract.
INTENTS = ["support_request", "billing_question", "refund_request", "order_status", "complaint",
           "partnership_inquiry", "general_inquiry", "spam", "urgent_issue"]
SENTIMENTS = ["positive", "neutral", "frustrated", "angry", "confused", "excited"]
URGENCIES = ["low", "normal", "high", "critical"]

CLASSIFY = (
    "Classify this customer email. Answer with one JSON object only, no markdown.\n\n"
    "From: {sender_name} <{sender_email}>\nSubject: {subject}\nBody: {body}\n\n"
    "Departments: {departments}\n\n"
    "Keys: intent (one of: " + ", ".join(INTENTS) + "), department (a name from the list), "
    "sentiment (one of: " + ", ".join(SENTIMENTS) + "), urgency (one of: " + ", ".join(URGENCIES) + "), "
    "summary (one sentence), key_topics (list of short strings).")

REPLY = (
    "Write a reply to this customer email, using only facts from the knowledge below.\n\n"
    "Knowledge:\n{context}\n\n"
    "From: {sender_name} <{sender_email}>\nSubject: {subject}\nMessage: {body}\n\n"
    "Intent: {intent}\nDepartment: {department}\nSentiment: {sentiment}\nUrgency: {urgency}\n\n"
    "Tone: {tone}\nSign with: {signature}\n"
    "Be empathetic first if the sender is frustrated or angry; match a positive sender's energy. "
    "No subject line; three to five short paragraphs.")

REGENERATE = (
    "Write an improved reply to this email.\n\nKnowledge:\n{context}\n\n"
    "From: {sender_name} <{sender_email}>\nSubject: {subject}\nBody: {body}\n\n"
    "Intent: {intent}, Sentiment: {sentiment}, Department: {department}{extra}")

_SLOT = re.compile(r"\{([a-z_]+)\}")


def _parts(template: str):
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            yield ("lit", template[pos:m.start()])
        yield ("slot", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("lit", template[pos:])


def render_spark(template: str, **slots: Column) -> Column:
    return F.concat(*[F.lit(v) if k == "lit" else slots[v] for k, v in _parts(template)])


def _sql_lit(s: str) -> str:
    out = []
    for piece in s.split("\n"):
        out.append("'" + piece.replace("'", "''") + "'")
    return " || chr(10) || ".join(out)


def render_sql(template: str, **slots: str) -> str:
    return " || ".join(_sql_lit(v) if k == "lit" else f"({slots[v]})" for k, v in _parts(template))
