"""Message ingest: sender parsing, body choice, dedup, insert-or-ignore and
the department dimension (P5, P7, D1, K1, S5).

Dedup is an aggregate (``min_by`` per key), not a window: it combines
map-side, so a message id repeated in a third of all rows is reduced in
every task before the shuffle instead of being gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import parse_sender, select_body

# Fixed seed rows of the department dimension.
SEED_DEPARTMENTS = [
    (1, "dept_support", "Support", "Customer support and technical issues", "friendly",
     "Best regards,\nSupport Team", 0.95),
    (2, "dept_billing", "Billing", "Payments, invoices, and refunds", "professional",
     "Kind regards,\nBilling Team", 0.95),
    (3, "dept_sales", "Sales", "New business and partnerships", "enthusiastic",
     "Looking forward to hearing from you,\nSales Team", 0.95),
    (4, "dept_general", "General", "General inquiries", "professional", "Best regards,\nTeam", 0.95),
]
DEPT_SCHEMA = ("ord int, id string, name string, description string, tone string, signature string, "
               "auto_send_threshold double")


def with_sender(df: DataFrame, raw: str = "sender_raw") -> DataFrame:
    s = parse_sender(raw)
    return df.withColumn("sender_name", s["name"]).withColumn("sender_email", s["email"])


def with_body(df: DataFrame) -> DataFrame:
    return df.withColumn("body_text", select_body("text_body", "html_body"))


def dedup_key(message_id: str = "message_id", row_id: str = "id") -> F.Column:
    """A missing message id becomes unique (generated from the row id)."""
    return F.coalesce(F.col(message_id), F.concat(F.lit("<generated-"), F.col(row_id), F.lit(">")))


def message_dedup(df: DataFrame) -> DataFrame:
    """First arrival per message id (by received_at, then id)."""
    keyed = df.withColumn("message_id", dedup_key())
    others = [c for c in keyed.columns if c != "message_id"]
    best = F.min_by(F.struct(*others), F.struct("received_at", "id"))
    return keyed.groupBy("message_id").agg(best.alias("_r")).select("message_id", "_r.*")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (deduplicated) whose message id is not stored
    yet; they enter with status 'processing'."""
    fresh = message_dedup(incoming)
    stored = existing.select("message_id").distinct()
    return (fresh.join(stored, "message_id", "left_anti")
            .withColumn("status", F.lit("processing")))


def departments(spark, existing: DataFrame | None = None) -> DataFrame:
    """Seeded dimension: seed rows whose id and name are both absent from
    ``existing`` are added to it (insert-if-absent)."""
    seed = spark.createDataFrame(SEED_DEPARTMENTS, DEPT_SCHEMA)
    if existing is None:
        return seed
    e = existing.select(*seed.columns)
    add = (seed.join(e.select("id"), "id", "left_anti")
               .join(e.select("name"), "name", "left_anti")
               .select(*seed.columns))
    return e.unionByName(add)
