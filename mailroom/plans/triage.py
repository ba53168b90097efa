"""End-to-end triage (M9) and its simulate variant (M10).

messages + model responses + knowledge base + departments
  -> parse -> resolve department -> search query -> top-k passages
  -> context -> confidence -> route -> message state + activity rows
  (+ the reply-drafting request table).

Identical search texts are searched once (keyed by the smallest message id) and
joined back, so duplicate subjects cost nothing in the similarity join.

Messages meet their responses once: the narrow columns of the pairs are written
and every output but the prompts follows from them. A subject does not pass
through the joins. Its digest (128 bits of SHA-256) and the rest of the search
text, which a response gives, stand for the text; each subject moves once, to its
search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import select_body
from ..functions.text import prefix
from ..operators import classify as C
from ..operators.knowledge import kb_index
from ..operators.similarity import (FALLBACK_CHARS, TOP_K, kb_context, rag_context, search,
                                    search_tail, with_chunk_text)
from ..session import written


@dataclass
class TriageResult:
    state: DataFrame        # one row per message with a response
    activity: DataFrame     # ai_processed rows (none for failed / simulated)
    context: DataFrame      # email_id, search_text, rag_context, n_hits
    reply_requests: DataFrame
    classify_requests: DataFrame
    unmatched: DataFrame    # responses without a stored message
    failed: DataFrame       # responses that cannot drive the pipeline
    cached: tuple = ()

    def release(self) -> None:
        """Drop the per-run cached inputs (used between stream batches)."""
        for df in self.cached:
            df.unpersist()


def triage(emails: DataFrame, responses: DataFrame, chunks: DataFrame, departments: DataFrame,
           auto_send_enabled: bool = True, simulate: bool = False, index: DataFrame | None = None,
           k: int = TOP_K) -> TriageResult:
    # A body is read for its length and for the start that goes into a prompt:
    # nothing else of it passes through the joins.
    body = select_body("text_body", "html_body")
    subject = F.coalesce("subject", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(subject.cast("binary"), 256)), 1, 16)
    msgs = emails.select("id", "message_id", "sender_name", "sender_email", "subject", "received_at", digest.alias("digest"),
                         F.length(body).alias("body_chars"), prefix(body, C.REPLY_BODY_CHARS).alias("body"))
    # Parsed responses are small per row and read by several branches below; they
    # are persisted so that a filter on ``outcome`` reads stored rows instead
    # of Catalyst inlining the whole JSON parse into each filter. The summary is
    # not needed here, so neither is the message's subject: one join follows.
    # Of a response's text only what a dead letter holds is kept.
    live = F.col("outcome") != C.OUTCOME_FAILED
    parsed = (C.parse_response_frame(responses.select(F.col("email_id").alias("id"), "response_text")
                                     .withColumn("subject", F.lit(None).cast("string")))
              .drop("subject", "summary").withColumn("response_text", F.when(~live, F.col("response_text")))
              .persist(StorageLevel.MEMORY_AND_DISK))
    # A failed response has no text to look up: its key is the message's, and no text has it.
    found = (msgs.join(parsed.drop("response_text"), "id")
             .withColumn("text_key", F.when(live, F.col("digest")).otherwise(F.col("id").cast("binary")))
             .withColumn("tail", F.when(live, search_tail(F.col("intent"), F.col("topics")))))
    text = ["text_key", "tail"]
    narrow = written(found.select("id", "message_id", "received_at", "body_chars", "outcome", "intent", "department",
                                  "sentiment", "urgency", *text), "triage-messages")

    # search each distinct text once
    asked = narrow.filter(live).groupBy(*text).agg(F.min("id").alias("q_id"))
    subjects = emails.groupBy(digest.alias("text_key")).agg(F.max(subject).alias("subject"))
    queries = written(asked.join(subjects, "text_key").select("q_id", *text, F.concat_ws(" ", "subject", "tail").alias("search_text")), "triage-texts")
    idx = index if index is not None else kb_index(chunks)
    hits = search(queries.select("q_id", F.col("search_text").alias("text")), idx, ["q_id"], k=k)
    ctx = written(rag_context(with_chunk_text(hits, chunks), ["q_id"]), "triage-contexts")
    per_text = queries.join(ctx, "q_id", "left").drop("q_id")
    kbctx = F.substring(kb_context(chunks).scalar(), 1, FALLBACK_CHARS)

    def with_context(rows: DataFrame) -> DataFrame:
        m = rows.join(per_text, text, "left")
        m = (m.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long"))
              .withColumn("has_kb", F.col("n_hits") > 0)
              .withColumn("rag_context", F.when(live, F.when(F.col("has_kb"), F.col("rag_context"))
                                                .otherwise(kbctx))))
        return C.resolve_department(m, departments)

    m = C.score(with_context(narrow), "has_kb", "body_chars")
    routed = (F.lit("pending_approval") if simulate
              else C.route(F.col("confidence_score"), F.col("auto_send_threshold"), auto_send_enabled))
    failed_str = F.lit(None).cast("string")
    state = m.select(
        "id",
        (F.concat(F.lit("<simulate-"), F.col("id"), F.lit("@local>")) if simulate
         else F.col("message_id")).alias("message_id"),
        F.when(live, routed).otherwise(F.lit("failed")).alias("status"),
        F.when(live, F.col("department")).otherwise(failed_str).alias("department"),
        F.when(live, F.col("intent")).otherwise(failed_str).alias("intent"),
        F.when(live, F.col("sentiment")).otherwise(failed_str).alias("sentiment"),
        F.when(live, F.col("urgency")).otherwise(F.lit("normal")).alias("urgency"),
        F.when(live, F.col("confidence_score")).otherwise(F.lit(0.0)).alias("confidence_score"),
        F.when(live, C.reasoning(F.col("intent"), F.col("department"), F.col("sentiment"), F.col("has_kb")))
        .otherwise(failed_str).alias("ai_reasoning"),
        F.when(live, F.col("has_kb")).otherwise(F.lit(False)).alias("has_kb"),
        "received_at")
    if simulate:
        activity = state.limit(0).select(
            F.col("id"), F.col("id").alias("email_id"), F.lit("ai_processed").alias("action"),
            F.lit("ai").alias("actor"), F.lit(None).cast("string").alias("details"),
            F.col("received_at").alias("created_at"))
    else:
        activity = m.filter(live).select(
            F.concat(F.lit("ai-"), F.col("id")).alias("id"), F.col("id").alias("email_id"),
            F.lit("ai_processed").alias("action"), F.lit("ai").alias("actor"),
            C.log_detail(F.col("intent"), F.col("confidence_score")).alias("details"),
            F.col("received_at").alias("created_at"))
    context = m.filter(live).select(F.col("id").alias("email_id"), "search_text", "rag_context", "n_hits")
    reply = with_context(found.filter(live)).select(F.col("id").alias("email_id"), C.reply_prompt(
        F.col("rag_context"), F.col("sender_name"), F.col("sender_email"), F.col("subject"), F.col("body"),
        F.col("intent"), F.col("department"), F.col("sentiment"), F.col("urgency"), F.col("tone"),
        F.col("signature")).alias("prompt"))
    classify = classify_requests(emails, departments)
    unmatched = responses.select("email_id", "response_text").join(emails.select(F.col("id").alias("email_id")), "email_id", "left_anti")
    failed = parsed.filter(~live).select(F.col("id").alias("email_id"), "response_text")
    return TriageResult(state, activity, context, reply, classify, unmatched, failed, (parsed,))


def classify_requests(emails: DataFrame, departments: DataFrame) -> DataFrame:
    """M1: one classification prompt per message."""
    return emails.select(F.col("id").alias("email_id"), C.classify_prompt(
        F.col("sender_name"), F.col("sender_email"), F.col("subject"),
        select_body("text_body", "html_body"), C.dept_list(departments)).alias("prompt"))


def regenerate_requests(emails: DataFrame, decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """M8: a redraft prompt per 'regenerate' decision on a known message."""
    regen = decisions.filter(F.col("action") == "regenerate").select(
        "email_id", "seq", "custom_instructions")
    # Only the messages that are to be redrafted move, with the part of the body
    # that a prompt holds. The ids are written first, so the planner knows their
    # size: few are broadcast to the messages, many are met in a shuffle.
    asked = written(regen.select(F.col("email_id").alias("id")).distinct(), "regenerate-ids")
    e = emails.join(asked, "id", "left_semi").select(
        F.col("id").alias("email_id"), "sender_name", "sender_email", "subject",
        prefix(select_body("text_body", "html_body"), C.REPLY_BODY_CHARS).alias("body"), "intent", "sentiment", "department")
    kbctx = kb_context(chunks).scalar()
    return regen.join(e, "email_id").select("email_id", "seq", C.regenerate_prompt(
        kbctx, F.col("sender_name"), F.col("sender_email"), F.col("subject"), F.col("body"),
        F.col("intent"), F.col("sentiment"), F.col("department"), F.col("custom_instructions")).alias("prompt"))
