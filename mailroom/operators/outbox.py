"""Reply messages (P6) and the outbox sink (K3). Delivery itself is outside
the engine; the outbox table is its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import reply_subject


def outgoing(messages: DataFrame) -> DataFrame:
    """Messages that have a reply to send, with ``reply_text``: auto-sent ones
    their draft, approved ones their final reply (the draft, if none is kept)."""
    final = F.col("final_reply") if "final_reply" in messages.columns else F.lit(None).cast("string")
    text = F.when(F.col("status") == "sent", F.coalesce(final, F.col("ai_draft"))).otherwise(F.col("ai_draft"))
    return messages.filter(F.col("status").isin("auto_sent", "sent")).withColumn("reply_text", text)


def compose_reply(messages: DataFrame, company: str, sender: str, body: str = "ai_draft",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """messages(id, message_id, sender_name, sender_email, subject, <body>)
    -> reply headers and bodies (plain, and html with line breaks as <br>);
    ``carry``: further columns to keep."""
    name = F.coalesce(F.col("sender_name"), F.lit(""))
    text = F.coalesce(F.col(body), F.lit(""))
    return messages.select(
        F.col("id").alias("email_id"),
        reply_subject("subject").alias("subject"),
        F.lit(f"{company} <{sender}>").alias("from_addr"),
        F.when(name != "", F.concat(name, F.lit(" <"), F.col("sender_email"), F.lit(">")))
        .otherwise(F.col("sender_email")).alias("to_addr"),
        F.nullif(F.col("message_id"), F.lit("")).alias("in_reply_to"),
        F.nullif(F.col("message_id"), F.lit("")).alias("references"),
        text.alias("text_body"),
        F.concat(F.lit("<html><body>"), F.replace(text, F.lit("\n"), F.lit("<br>")),
                 F.lit("</body></html>")).alias("html_body"), *carry)


def write_outbox(replies: DataFrame, path: str, run_id: str, day: str = "day") -> None:
    """Write a run's replies to the outbox table, partitioned by run and day.
    A run that is repeated replaces its own rows."""
    (replies.withColumn("run_id", F.lit(run_id)).write.option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").partitionBy("run_id", day).parquet(path))
